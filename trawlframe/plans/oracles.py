"""DuckDB SQL for the crawl engine's queries, on the same tables. Written apart from the Spark plans."""

from __future__ import annotations

from .queries import FRONTIER_LIMIT, PAGE_LIMIT, REFS, RETRY_CONFIGS, SIZE_LIMIT

#: Anchors of the driver's pages; their markup is plain enough for RE2.
_HREF = """regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)"""


def _restored(encoded: str) -> str:
    for code, c in {"%24": "$", "%26": "&", "%2B": "+", "%2C": ",", "%2F": "/", "%3A": ":", "%3B": ";", "%3D": "=", "%40": "@", "%7E": "~"}.items():
        encoded = f"replace({encoded}, '{code}', '{c}')"
    return encoded


def _encoded(path: str) -> str:
    plain = "[A-Za-z0-9\\-_.~$&+,/:;=@!''()*\\[\\]%]*"
    return f"CASE WHEN regexp_full_match({path}, '{plain}') THEN {path} ELSE {_restored(f'url_encode({path})')} END"


#: Pages with the parts of their URLs, and the path as it is saved.
_PAGES = """
p AS (
  SELECT *, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host,
         regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
         nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment
  FROM pages),
s AS (
  SELECT *, CASE WHEN path = '' THEN 'index.html' WHEN regexp_full_match(path, '/+') THEN '/index.html'
                 WHEN path LIKE '%/' THEN rtrim(url_decode(path), '/') || '/' || regexp_extract(url_decode(path), '([^/]*)/+$', 1) || '.html'
                 ELSE url_decode(path) || '.html' END AS save_path FROM p)"""
_LINKS = f"""
l AS (
  SELECT page_id, url, scheme, host, save_path, unnest({_HREF}) AS href, unnest(range(0, len({_HREF}))) AS pos FROM s),
k AS (SELECT *, scheme || '://' || host || {_encoded('href')} AS link_url FROM l)"""
_UP = "repeat('../', greatest(len(string_split(save_path, '/')) - 2, 0))"
_REL = f"CASE WHEN save_path = 'index.html' OR {_UP} = '' THEN './' ELSE {_UP} END || ltrim(href, '/') || '.html'"

#: The derived pages' own references, one row each.
_ADDED = """
dir AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END AS dir FROM s),
up AS (SELECT *, CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]*/$', '') END AS parent FROM dir),
added AS (
  SELECT page_id, url, scheme, host, save_path, path, query, fragment, t.tag, t.kind, t.target, t.saved FROM up, LATERAL (VALUES
    ('img', 'image', '/img/' || page_id % 7 || '.png', '/img/' || page_id % 7 || '.png'),
    ('link', 'css', parent || 'css/' || page_id % 3 || '.css?v=1', parent || 'css/' || page_id % 3 || '.css'),
    ('script', 'script', dir || 'app.js', dir || 'app.js'),
    ('a', 'page', path || coalesce('?' || query, '') || coalesce('#' || fragment, ''), ''),
    ('a', 'page', path || '?page=2', ''),
    ('a', 'page', parent || 'up/x.html', ''),
    ('a', 'page', path || coalesce('?' || query, '') || coalesce('#' || fragment, ''), '')) t(tag, kind, target, saved))"""


def _ref_cases() -> str:
    base = "scheme || '://' || host"
    own = f"{base} || path || coalesce('?' || query, '') || coalesce('#' || fragment, '')"
    found = {
        "x.html": f"{base} || dir || 'x.html'",
        "../x": f"{base} || parent || 'x'",
        "../../../x": f"{base} || regexp_replace(regexp_replace(regexp_replace(dir, '[^/]+/$', ''), '[^/]+/$', ''), '[^/]+/$', '') || 'x'",
        "/x/./y/../z": f"{base} || '/x/z'",
        "?page=2": f"{base} || path || '?page=2'",
        "": own,
        "#s": own,
        "x#s": f"{base} || dir || 'x'",
        "/für": f"{base} || '/f%C3%BCr'",
        "x y": f"{base} || dir || 'x%20y'",
    }
    return "CASE " + " ".join(f"WHEN ref = '{r}' THEN {e}" for r, e in found.items()) + " END"


def _duration(us: str) -> str:
    trimmed = lambda x: f"regexp_replace(printf('%.6f', {x}), '\\.?0+$', '')"
    return f"""CASE WHEN {us} = 0 THEN '0s' WHEN {us} < 1000 THEN {us} || 'µs' WHEN {us} < 1000000 THEN {trimmed(f'{us} / 1000.0')} || 'ms'
      ELSE CASE WHEN {us} >= 3600000000 THEN ({us} // 3600000000) || 'h' ELSE '' END
        || CASE WHEN {us} >= 60000000 THEN ({us} % 3600000000 // 60000000) || 'm' ELSE '' END || {trimmed(f'({us} % 60000000) / 1000000.0')} || 's' END"""


_LOG = """
log AS (
  SELECT *, event_type <> 'error' AS ok, CAST(round(value * 1000) AS BIGINT) AS response_us FROM events)"""


def _stats(by: str = "") -> str:
    return f"""
SELECT {by + ',' if by else ''} count(*) FILTER (ok) AS pages_crawled, count(*) FILTER (NOT ok) AS pages_failed,
  CAST(sum(event_id % 7) AS BIGINT) AS links_discovered, CAST(sum(event_id % 3) AS BIGINT) AS assets_found,
  CAST(sum(strlen(props)) AS BIGINT) AS bytes_downloaded, min(ts) AS start_time, max(ts) FILTER (ok) AS last_crawl_time,
  count(response_us) AS response_count, 'failed: ' || arg_max(event_id, (ts, event_id)) FILTER (NOT ok) AS last_error,
  max(ts) FILTER (NOT ok) AS last_error_time, count(*) FILTER (NOT ok) AS error_count,
  arg_max(user_id % 10 + 1, (ts, event_id)) AS active_workers, CAST(10 AS BIGINT) AS total_workers,
  epoch_us(max(ts)) - epoch_us(min(ts)) AS uptime_us, CAST(sum(response_us) // count(response_us) AS BIGINT) AS avg_response_us,
  CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) * 100 AS success_rate,
  CASE WHEN max(ts) = min(ts) THEN 0.0 ELSE CAST(count(*) FILTER (ok) AS DOUBLE) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) END AS crawl_rate
FROM log {'GROUP BY ' + by if by else ''}"""


_N = "(SELECT count(*) FROM pages)"
_SEEN = f"WITH {_PAGES}, {_LINKS} SELECT url FROM pages UNION SELECT link_url FROM k"

ORACLES = {
    "page_resources": f"SELECT page_id, unnest(range(0, len({_HREF}))) AS pos, 'a' AS tag, unnest({_HREF}) AS source_url FROM pages",
    "resource_attributes": "SELECT page_id, 'stylesheet' AS rel, CAST(2 AS BIGINT) AS n_attrs FROM pages",
    "resource_counts": f"SELECT page_id, CAST(len({_HREF}) AS BIGINT) AS n_links, CAST(0 AS BIGINT) AS n_assets FROM pages",
    "url_parts": f"WITH {_PAGES} SELECT page_id, scheme, host, path, query, fragment FROM p",
    "page_links": f"WITH {_PAGES}, {_LINKS} SELECT page_id, pos, link_url FROM k",
    "external_refs_dropped": f"SELECT page_id, CAST(len({_HREF}) + 7 AS BIGINT) AS kept, CAST(2 AS BIGINT) AS external, CAST(0 AS BIGINT) AS invalid FROM pages",
    "resolve_refs": f"""WITH {_PAGES}, {_ADDED}, r AS (SELECT *, unnest([{', '.join(f"'{r}'" for r in REFS)}]) AS ref FROM up), f AS (SELECT page_id, ref, {_ref_cases()} AS abs_url FROM r)
      SELECT page_id, ref, abs_url IS NOT NULL AS kept, abs_url FROM f""",
    "page_save_path": f"WITH {_PAGES} SELECT page_id, save_path FROM s",
    "link_save_path": f"""WITH {_PAGES}, {_LINKS}, {_ADDED},
      t AS (SELECT page_id, n, scheme || '://' || host || target AS full_url, regexp_replace(target, '[?#].*$', '') AS plain
        FROM up, LATERAL (VALUES (0, path || coalesce('?' || query, '') || coalesce('#' || fragment, '')), (1, path || '?page=2'), (2, parent || 'up/x.html'),
                                 (4, path || coalesce('?' || query, '') || coalesce('#' || fragment, ''))) v(n, target)),
      more AS (SELECT page_id, n, CASE WHEN regexp_full_match(plain, '/*') THEN plain || md5(full_url)
          WHEN plain LIKE '%/' THEN rtrim(url_decode(plain), '/') || '/' || regexp_extract(url_decode(plain), '([^/]*)/+$', 1)
          ELSE url_decode(plain) END || '.html' AS save_path FROM t),
      sizes AS (SELECT page_id, len({_HREF}) AS held FROM pages)
      SELECT page_id, pos, href || '.html' AS save_path FROM k
      UNION ALL SELECT page_id, held + CASE n WHEN 4 THEN 4 ELSE n END, save_path FROM more JOIN sizes USING (page_id)""",
    "save_collisions": f"WITH {_PAGES} SELECT host, save_path, count(*) AS n FROM s GROUP BY host, save_path HAVING count(*) > 1",
    "saved_pages": f"WITH {_PAGES} SELECT max(page_id) AS page_id, host, save_path FROM s GROUP BY host, save_path",
    "colliding_paths": "SELECT 'site.example' AS host, '/p/' || (page_id // 40) || '.html' AS save_path, count(*) AS n FROM pages GROUP BY ALL HAVING count(*) > 1",
    "colliding_winners": "SELECT max(page_id) AS page_id, 'site.example' AS host, '/p/' || (page_id // 40) || '.html' AS save_path FROM pages GROUP BY page_id // 40",
    "saved_files": "SELECT (page_id // 40) || '.html' AS name, max_by(octet_length(encode(html)), page_id) AS n_bytes, max_by(md5(html), page_id) AS md5, CAST(NULL AS VARCHAR) AS skipped_on FROM pages GROUP BY page_id // 40",
    "fetch_errors": """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'cancelled' WHEN event_id % 13 = 0 THEN 'http'
      WHEN [200, 204, 301, 404, 500][event_id % 5 + 1] <> 200 THEN 'status' END AS error FROM events""",
    "asset_occurrences": f"WITH {_PAGES}, {_ADDED} SELECT scheme || '://' || host || target AS asset_url, page_id, count(*) AS k FROM added WHERE tag <> 'a' GROUP BY 1, 2",
    "relative_links": f"WITH {_PAGES}, {_LINKS} SELECT page_id, pos, {_REL} AS rel_url FROM k",
    "asset_rows": f"WITH {_PAGES}, {_ADDED} SELECT page_id, tag, kind AS asset_kind, scheme || '://' || host || target AS asset_url, saved AS save_path FROM added WHERE tag <> 'a'",
    "asset_url_map": f"""WITH {_PAGES}, {_ADDED} SELECT scheme || '://' || host || target AS asset_url, count(*) AS n, string_agg(page_id, ',' ORDER BY page_id) AS page_ids
      FROM added WHERE tag <> 'a' GROUP BY 1""",
    "page_children": f"""WITH {_PAGES}, {_LINKS}, {_ADDED}, c AS (
        SELECT url AS src_url, 'page' AS kind, link_url AS dst FROM k
        UNION ALL SELECT url, CASE WHEN tag = 'a' THEN 'page' ELSE 'asset' END, scheme || '://' || host || target FROM added)
      SELECT src_url, kind, count(*) AS n, count(DISTINCT dst) AS n_distinct FROM c GROUP BY src_url, kind""",
    "seen_dedup": _SEEN,
    "frontier_limit": f"""WITH {_PAGES}, {_LINKS}, i AS (SELECT url, page_id, -1 AS pos FROM pages UNION ALL SELECT link_url, page_id, pos FROM k),
      f AS (SELECT url, min((page_id, pos)) AS o FROM i GROUP BY url) SELECT url, row_number() OVER (ORDER BY o) - 1 AS rank FROM f ORDER BY o LIMIT {FRONTIER_LIMIT}""",
    "crawl_bfs": f"""WITH RECURSIVE b(id, level) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT)
        UNION SELECT unnest([(2 * id + 1) % {_N}, (7 * id + 3) % {_N}, id]), level + 1 FROM b WHERE level < 40)
      SELECT 'https://site.example/p/' || id AS url, min(level) AS level FROM b GROUP BY id""",
    "crawl_bfs_limited": f"""WITH RECURSIVE w(k, q) AS (SELECT 1, [CAST(0 AS BIGINT)] UNION ALL
        SELECT k + 1, CASE WHEN list_contains(r, y) OR len(r) >= {PAGE_LIMIT} THEN r ELSE list_append(r, y) END FROM (
          SELECT k, CASE WHEN list_contains(q, x) OR len(q) >= {PAGE_LIMIT} THEN q ELSE list_append(q, x) END AS r, y FROM (
            SELECT k, q, (2 * q[k] + 1) % {_N} AS x, (7 * q[k] + 3) % {_N} AS y FROM w WHERE k <= len(q) AND k < {PAGE_LIMIT})))
      SELECT 'https://site.example/p/' || unnest(q) AS url, unnest(range(0, len(q))) AS rank FROM (SELECT q FROM w ORDER BY k DESC LIMIT 1)""",
    "fetch_left_join": f"""WITH {_PAGES}, {_LINKS}, f AS (SELECT url FROM pages UNION SELECT link_url FROM k), c AS (SELECT url, strlen(arg_min(html, page_id)) AS n FROM pages GROUP BY url)
      SELECT url, CASE WHEN coalesce(n, {SIZE_LIMIT + 1}) > {SIZE_LIMIT} THEN 'download' END AS skipped_on, CASE WHEN n <= {SIZE_LIMIT} THEN n ELSE 0 END AS n_bytes FROM f LEFT JOIN c USING (url)""",
    "size_guard": f"SELECT page_id, strlen(html) AS n_bytes, strlen(html) <= {SIZE_LIMIT} AS allowed FROM pages",
    "fanin_union": f"""WITH e AS (SELECT strlen(html) + strlen('<img src="/img/.png"><link rel=stylesheet href="../css/.css?v=1#x"><script src="https://cdn.example.org/.js"></script><script src="app.js"></script><a href="#sec">s</a><a href="?page=2">n</a><a href="../up/x.html#f">u</a><a href="mailto:a@b.c">m</a><a name="n">x</a><a href="">e</a>') + 3 AS n FROM pages)
      SELECT 'page' AS kind, count(*) AS n, count(*) FILTER (n > {SIZE_LIMIT}) AS skipped FROM e UNION ALL SELECT 'asset', 3 * count(*), 0 FROM e""",
    "crawl_stats": f"WITH {_LOG} {_stats()}",
    "crawl_stats_by_user": f"WITH {_LOG} {_stats('user_id')}",
    "stats_line": f"""WITH {_LOG}, t AS ({_stats()}) SELECT 'Pages: ' || pages_crawled || ' crawled, ' || pages_failed || ' failed | Links: ' || links_discovered || ' | asset: ' || assets_found
      || ' | Bytes: ' || bytes_downloaded || ' | Workers: ' || active_workers || '/' || total_workers || ' | Uptime: ' || {_duration('uptime_us')} || ' | Avg Response: ' || {_duration('avg_response_us')} AS line FROM t""",
    "retry_schedule": f"""SELECT cfg, unnest(range(0, n)) AS attempt, unnest(list_transform(range(0, n), lambda i: least(d * pow(f, i), CAST(m AS DOUBLE)))) AS delay_ms
      FROM (VALUES {', '.join(f"('{c}', {n}, {d}, {m}, CAST({f} AS DOUBLE))" for c, n, d, m, f in RETRY_CONFIGS)}) t(cfg, n, d, m, f)""",
    "retry_outcome": """WITH t AS (SELECT user_id, event_type <> 'error' AS ok, value < 50 AS again, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
      e AS (SELECT user_id, coalesce(min(n) FILTER (ok OR NOT again), max(n)) AS last FROM t WHERE n <= 3 GROUP BY user_id)
      SELECT e.user_id AS id, last AS attempts, ok FROM e JOIN t ON t.user_id = e.user_id AND t.n = last""",
    "rewrite_map": f"WITH {_PAGES}, {_LINKS} SELECT page_id, pos, href AS old_url, {_REL} AS new_url FROM k",
    "rewrite_html": f"""WITH {_PAGES} SELECT page_id, regexp_replace(html, '(?i)(<a\\s[^>]*href=")/?([^"]*)"',
      '\\1' || CASE WHEN save_path = 'index.html' OR {_UP} = '' THEN './' ELSE {_UP} END || '\\2.html"', 'g') AS html FROM s""",
    "stream_page_links": f"WITH {_PAGES}, {_LINKS} SELECT page_id, pos, link_url FROM k",
    "stream_seen_dedup": _SEEN,
    "stream_stats": f"WITH {_LOG} {_stats()}",
    "stream_frontier": f"SELECT url FROM (SELECT url, min(page_id) AS o FROM pages GROUP BY url ORDER BY o LIMIT {FRONTIER_LIMIT})",
}
