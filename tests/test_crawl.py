import http.server
import threading
import time

import pytest

from trawlframe import config, storage
from trawlframe.operators import extract, fetch, frontier, metrics, retry, saving
from trawlframe.operators.retry import Cancelled, RetryConfig
from trawlframe.plans import queries
from trawlframe.session import spread
from trawlframe.sources import http as live
from trawlframe.sources import sinks, tables
from trawlframe.streaming import stream


def test_walk_levels(spark, sf):
    found = queries.crawl_bfs(spark, sf).groupBy("level").count().orderBy("level").collect()
    assert [r["count"] for r in found] == [1, 2, 3, 5, 8, 13, 11, 5, 2]


@pytest.mark.parametrize(("parts", "small"), [(1, 100), (7, 100), (7, 3)])
def test_limited_crawl_keeps_its_order_however_edges_are_dealt(spark, sf, parts, small, monkeypatch):
    monkeypatch.setattr(frontier, "SMALL_LIMIT", small)
    edges = queries.site_edges(spark, sf).repartition(parts)
    found = frontier.crawl(edges, tables.seeds(spark, "https://site.example/p/0"), 20).orderBy("rank").collect()
    assert [int(r.url.rsplit("/", 1)[1]) for r in found] == [0, 1, 3, 10, 7, 24, 21, 23, 15, 2, 49, 43, 47, 14, 31, 8, 5, 17, 46, 37]
    assert [r["rank"] for r in found] == list(range(20))


def test_refused_pages_stay_seen_and_assets_have_no_limit(spark):
    rows = [("s", "page", 0, 0, "a"), ("s", "page", 0, 1, "b"), ("s", "asset", 1, 0, "x"), ("a", "asset", 1, 0, "b"), ("a", "asset", 1, 1, "y"), ("a", "asset", 1, 2, "x")]
    edges = spark.createDataFrame(rows, "src_url string, kind string, kind_rank int, pos long, dst_url string")
    found = frontier.crawl(edges, tables.seeds(spark, "s", "s"), 2).orderBy("rank").collect()
    assert [(r.url, r.kind, r.level) for r in found] == [("s", "page", 0), ("a", "page", 1), ("x", "asset", 1), ("y", "asset", 2)]


def test_merge_summary_and_dedup(spark):
    a = spark.createDataFrame([("u", "page", None), ("v", "asset", "download")], "url string, kind string, skipped_on string")
    assert sorted((r.kind, r.n, r.skipped) for r in frontier.summary(frontier.merged([a, a])).collect()) == [("asset", 2, 2), ("page", 2, 0)]
    items = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("w", 5, "c")], "url string, o int, x string")
    assert sorted(map(tuple, frontier.first_of_each(items, "url", ["o"]).collect())) == [("u", 1, "a"), ("w", 5, "c")]


def test_size_guard_and_missing_pages(spark):
    pages = spark.createDataFrame([(1, "a", "12345"), (2, "b", "123456"), (3, "a", "later")], "page_id long, url string, html string")
    got = fetch.fetched(tables.seeds(spark, "a", "b", "c"), pages, 5).collect()
    assert sorted((r.url, r.content, r.skipped_on) for r in got) == [("a", "12345", None), ("b", None, "download"), ("c", None, "download")]
    lengths = spark.createDataFrame([("5",), ("6",), ("x",), (None,)], "n string")
    assert [r[0] for r in lengths.select(fetch.allowed(lengths["n"], 5)).collect()] == [True, False, True, True]


def tries(outcomes, **settings):
    calls, waits = [], []

    def call():
        calls.append(1)
        o = outcomes[min(len(calls), len(outcomes)) - 1]
        if isinstance(o, Exception):
            raise o
        return o

    try:
        result = retry.retry(call, RetryConfig(**settings), sleep=waits.append)
    except Exception as e:
        result = e
    return result, len(calls), waits


def test_retry():
    error = ValueError("x")
    assert tries([7]) == (7, 1, [])
    assert tries([error, 8], jitter_factor=0) == (8, 2, [1.0])
    assert tries([error], delay=0.1, jitter_factor=0, backoff_factor=3) == (error, 3, pytest.approx([0.1, 0.3, 0.9]))
    assert tries([error], delay=0.1, jitter_factor=0, backoff_factor=0)[2] == pytest.approx([0.1, 0, 0])
    assert tries([error], max_attempts=4, jitter_factor=0, backoff_factor=2)[2] == [1, 2, 3, 3]
    asked = []
    assert tries([error], retryable=lambda e: bool(asked.append(e)))[1] == 1 and asked == [error]
    assert all(0.1 <= w <= 0.13 for w in tries([error], delay=0.1, jitter_factor=0.3)[2])
    with pytest.raises(Cancelled):
        retry.retry(lambda: 1, cancelled=lambda: True)
    for bad in ({"max_attempts": 0}, {"delay": -1}, {"backoff_factor": -1}, {"jitter_factor": 2}):
        with pytest.raises(ValueError):
            RetryConfig(**bad)


def test_config():
    env = {"CRAWLER_URL": "http://e", "CRAWLER_MAX_COUNT": "x", "CRAWLER_TIMEOUT": "1m30s", "CRAWLER_RETRY_ATTEMPTS": "", "CRAWLER_MAX_FILE_SIZE": "9"}
    c = config.load(["--max-concurrent=3", "-retry-delay", "100ms"], env)
    assert (c.url, c.max_count, c.timeout, c.retry_attempts, c.max_file_size, c.max_concurrent, c.retry_delay) == ("http://e", 100, 90, 3, 9, 3, 0.1)
    assert str(c) == "Config{MaxCount: 100, MaxConcurrent: 3, URL: http://e, Timeout: 1m30s, RetryAttempts: 3, RetryDelay: 100ms, OutputDir: ./.tmp/, LogLevel: info}"
    for bad in (["--max-count=0"], ["--max-concurrent=-1"], ["--timeout=0s"], ["--retry-attempts=0"], ["--retry-delay=-1s"], ["--output-dir="], ["--log-level=loud"], ["--url="]):
        with pytest.raises(ValueError):
            config.load(bad, env)
    assert [str(config.Duration.parse(x)) for x in ("1h2m3.5s", "0", "1500us", "2ms", "90s", "1h")] == ["1h2m3.5s", "0s", "1.5ms", "2ms", "1m30s", "1h0m0s"]


def test_statistics_of_nothing(spark, sf):
    r = metrics.stats(tables.crawl_log(spark, sf).limit(0)).first()
    assert (r.pages_crawled, r.success_rate, r.crawl_rate, r.avg_response_us, r.last_error) == (0, 0.0, 0.0, 0, None)


def test_durations(spark):
    rows = spark.createDataFrame([(0,), (5,), (1500,), (2_000_000,), (61_500_000,), (3_600_000_000,)], "us long")
    assert [r[0] for r in rows.select(metrics.duration_text(rows["us"])).collect()] == ["0s", "5µs", "1.5ms", "2s", "1m1.5s", "1h0m0s"]


class Site(http.server.BaseHTTPRequestHandler):
    agents: list = []
    flaky = {"n": 0}

    def do_HEAD(self):
        self.send_response(200)
        self.send_header("Content-Length", "99" if self.path == "/big" else "2")
        self.end_headers()

    def do_GET(self):
        self.agents.append(self.headers["User-Agent"])
        self.flaky["n"] += self.path == "/flaky"
        self.send_response(404 if self.path == "/missing" else 204 if self.path == "/empty" else 500 if self.path == "/flaky" and self.flaky["n"] < 2 else 200)
        self.end_headers()
        if self.path != "/empty":
            self.wfile.write(b"x" * 50 if self.path == "/liar" else b"ok")

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_live_fetch(spark, site):
    urls = [f"{site}/{x}" for x in ("a", "missing", "empty", "flaky", "big", "liar")]
    found = live.fetch_live(tables.seeds(spark, *urls), 2, 5, "tester", 10, RetryConfig(delay=0.01)).collect()
    got = {r.url.rsplit("/", 1)[1]: (bytes(r.content) if r.content is not None else None, r.skipped_on) for r in found}
    gone = (None, "download")
    assert got == {"a": (b"ok", None), "missing": gone, "empty": gone, "flaky": (b"ok", None), "big": gone, "liar": gone}
    assert set(Site.agents) == {"tester"}


def test_site_source(spark, site):
    spark.dataSource.register(live.SiteSource)
    found = spark.read.format("site").option("urls", f"{site}/a\n{site}/missing").option("delay", "0.01").load().collect()
    assert sorted((r.url.rsplit("/", 1)[1], r.skipped_on) for r in found) == [("a", None), ("missing", "download")]


def test_files_last_writer_wins(spark, tmp_path):
    rows = [("h", "/a/b.html", "first", 1), ("h", "/a/b.html", "last", 2), ("h", "/c", "ü", 3), ("h", "/d", None, 4), ("h", "/c/below", "x", 5)]
    items = spark.createDataFrame(rows, "host string, save_path string, content string, rank int")
    found = {r.save_path: r.skipped_on for r in sinks.save_files(items.filter("rank < 5"), str(tmp_path)).collect()}
    assert found == {"/a/b.html": None, "/c": None}
    assert (tmp_path / "a/b.html").read_text() == "last" and (tmp_path / "c").read_text() == "ü"
    blocked = sinks.save_files(items.filter("rank = 5"), str(tmp_path), config=RetryConfig(delay=0)).collect()
    assert [r.skipped_on for r in blocked] == ["save"]
    sinks.save_table(items, f"{tmp_path}/t", "host")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 5


def test_stream_frontier_over_batches(spark, tmp_path):
    for i, part in enumerate([["a", "b", "a"], ["b", "c"], ["d", "c", "e"]]):
        rows = [(u, "page", 10 * i + k) for k, u in enumerate(part)] + [("x", "asset", 10 * i + 9)]
        spark.createDataFrame(rows, "url string, kind string, ord long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        time.sleep(0.05)
    source = spark.readStream.schema("url string, kind string, ord long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = stream.StreamFrontier(spark, 3).run(source).collect()
    assert sorted((r.url, r.kind) for r in found) == [("a", "page"), ("b", "page"), ("c", "page"), ("x", "asset")]


def test_spread_leaves_large_scans_alone(spark):
    assert spread(spark.range(100, numPartitions=50)).rdd.getNumPartitions() == 50
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() > 1


class LinkedSite(Site):
    pages = {
        "/": b'<link rel=stylesheet href="/s/a.css"><a href="/one?x=1">1</a><a href="two/">2</a><a href="http://other.example/">o</a>',
        "/one?x=1": b'<a href="/">up</a><a href="/gone">g</a><img src="/i.png">',
        "/two/": "<a href='../für'>f</a>".encode(),
        "/f%C3%BCr": b"<p>end</p><a href=/beyond>b</a>",
        "/s/a.css": b"a{}",
        "/i.png": b"\x89PNG\xff",
    }

    def do_HEAD(self):
        self.send_response(200)
        self.end_headers()

    def do_GET(self):
        self.send_response(200 if self.path in self.pages else 404)
        self.end_headers()
        self.wfile.write(self.pages.get(self.path, b""))


def test_whole_crawl(spark, tmp_path):
    from trawlframe.plans.crawl import crawl

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), LinkedSite)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    settings = config.CrawlConfig(url=f"{base}/", max_count=5, max_concurrent=2, retry_delay=config.Duration(0.01), output_dir=str(tmp_path)).validated()
    found = crawl(spark, settings).orderBy("rank").collect()
    server.shutdown()
    assert [(r.url.removeprefix(base), r.kind, r.level, r.skipped_on) for r in found] == [
        ("/", "page", 0, None), ("/one?x=1", "page", 1, None), ("/two/", "page", 1, None), ("/s/a.css", "asset", 1, None),
        ("/gone", "page", 2, "download"), ("/i.png", "asset", 2, None), ("/f%C3%BCr", "page", 2, None),
    ]
    assert (tmp_path / "i.png").read_bytes() == b"\x89PNG\xff" and (tmp_path / "s/a.css").exists() and not (tmp_path / "gone.html").exists()
    assert (tmp_path / "index.html").read_text() == '<link rel=stylesheet href="./s/a.css"><a href="./one.html">1</a><a href="./two/two.html">2</a><a href="http://other.example/">o</a>'
    assert (tmp_path / "two/two.html").read_text() == '<a href="../für.html">f</a>'


def test_crawl_of_a_table(spark, sf, tmp_path):
    from trawlframe.plans.crawl import crawl, table_fetcher

    pages = tables.site_pages(spark, sf)
    settings = config.CrawlConfig(url="https://site.example/p/0", max_count=4, output_dir=str(tmp_path))
    found = crawl(spark, settings, table_fetcher(pages)).orderBy("rank").collect()
    assert [r.url.rsplit("/", 1)[1] for r in found] == ["0", "1", "3", "10"] and (tmp_path / "p/0.html").exists()


def test_pages_are_rewritten_whatever_their_ids(spark):
    doc = '<A class=x HREF="two.html#f">2</A><img alt="a>b" src=/i.png><a href="http://o.example/">o</a><!-- <a href="no"> -->'
    rows = [(1, "http://h.example/one", doc), (1, "http://h.example/deep/one", doc), (None, "http://h.example/", doc), (2, "http://h.example/x", None), (3, "http://h.example/y", "plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.url: r.html for r in saving.rewritten(pages).collect()}
    new = '<A class=x href="./two.html.html">2</A><img alt="a>b" src="./i.png"><a href="http://o.example/">o</a><!-- <a href="no"> -->'
    assert found["http://h.example/one"] == found["http://h.example/"] == new
    assert found["http://h.example/deep/one"] == new.replace("./i.png", "../i.png")
    assert found["http://h.example/x"] is None and found["http://h.example/y"] == "plain"
    plan = saving.rewritten(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_fetch_shuffles_keys_before_content(spark, tmp_path):
    rows = [(2, "a", "second"), (1, "a", "first"), (1, "a", "first again"), (None, "a", "no id"), (5, "b", "x" * 9), (None, "c", "alone")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages")
    got = fetch.fetched(tables.seeds(spark, "a", "b", "c", "d"), spark.read.parquet(f"{tmp_path}/pages"), 8)
    assert sorted((r.url, r.content, r.skipped_on) for r in got.collect()) == [("a", "first", None), ("b", None, "download"), ("c", "alone", None), ("d", None, "download")]
    lines = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, x in enumerate(lines) if "Aggregate" in x and "page_id" in x)  # what names the pages, and all below it
    assert not any("html" in x for x in lines[first:] if "Relation" not in x)


def test_asset_occurrences_are_rows(spark):
    found = spark.createDataFrame([("a", 1), ("a", 2), ("a", 1), ("b", 2)], "asset_url string, page_id long")
    assert sorted(map(tuple, extract.occurrences(found).collect())) == [("a", 1, 2), ("a", 2, 1), ("b", 2, 1)]
    assert sorted(map(tuple, extract.occurrences_by_url(found).collect())) == [("a", 3, "1,1,2"), ("b", 1, "2")]


def test_edges_are_not_shuffled_again(spark):
    edges = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(50)], "src_url string, dst_url string")
    with frontier.dealt(edges, "src_url") as laid:
        plan = laid.join(edges.select("src_url").hint("merge"), "src_url")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and laid.count() == 50
        name = laid.inputFiles()[0]
    assert name and not [t for t in spark.catalog.listTables() if t.name.startswith("trawlframe_edges")]


def test_growing_table(spark):
    grown = storage.Batches(spark, "test", "x long")
    assert grown.upto(0).count() == 0
    grown.put(spark.range(3).selectExpr("id as x"), 0)
    grown.put(spark.range(5).selectExpr("id as x"), 1)
    grown.put(spark.range(2).selectExpr("id as x"), 1)  # a batch that is run again
    assert grown.upto(1).count() == 3 and grown.upto(2).count() == 5


def test_tables_are_removed_when_told(spark):
    import os

    before = storage.written()
    kept, gone = (storage.materialize(spark.range(3).toDF("x"), "t") for _ in range(2))
    storage.release(before, kept)
    assert kept.count() == 3 and not os.path.exists(gone._trawlframe_path)
    storage.discard(kept, spark.range(1))
    assert not os.path.exists(kept._trawlframe_path)


def test_no_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "yarn"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())


def test_stream_frontier_goes_on_after_a_restart(spark, tmp_path):
    def part(i, urls):
        rows = [(u, "page", 10 * i + k) for k, u in enumerate(urls)]
        spark.createDataFrame(rows, "url string, kind string, ord long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")

    def source():
        return spark.readStream.schema("url string, kind string, ord long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    part(0, ["a", "b"])
    part(1, ["b", "c"])
    assert {r.url for r in stream.StreamFrontier(spark, 4, f"{tmp_path}/f").run(source()).collect()} == {"a", "b", "c"}
    part(2, ["a", "d", "e"])
    assert {r.url for r in stream.StreamFrontier(spark, 4, f"{tmp_path}/f").run(source()).collect()} == {"a", "b", "c", "d"}


def test_streams_over_several_batches(spark, sf, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    source = lambda: spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/pages.parquet")
    assert stream.drain(stream.seen_dedup(stream.urls_of(source())), "t").count() == queries.seen_dedup(spark, sf).count()
    assert stream.drain(stream.page_links(source()), "t").count() == queries.page_links(spark, sf).count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_command_line(tmp_path):
    """A whole crawl by the command line: progress by level, a summary, files."""
    import os
    import subprocess
    import sys

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), LinkedSite)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    args = [sys.executable, "-m", "trawlframe", "--url", f"http://127.0.0.1:{server.server_port}/", "--output-dir", str(tmp_path), "--max-concurrent=2", "--retry-delay=10ms"]
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "SPARK_MASTER": "local[2]"}
    done = subprocess.run(args, env=env, capture_output=True, text=True, timeout=300)
    server.shutdown()
    assert done.returncode == 0 and "pages and" in done.stderr and "crawl finished" in done.stderr and (tmp_path / "index.html").exists()
    bad = subprocess.run([*args[:3], "--url="], env=env, capture_output=True, text=True, timeout=100)
    assert bad.returncode == 2
