"""The crawl engine's queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, paths, urls
from ..operators import extract, fetch, frontier, metrics, retry, saving
from ..session import spread, table
from ..sources import sinks, tables
from ..storage import materialize, scratch
from ..streaming import stream

#: Page limit and size limit of the queries that have one as their feature.
PAGE_LIMIT, SIZE_LIMIT = 20, 8192
FRONTIER_LIMIT = 100
#: References that every page is asked to resolve.
REFS = ["x.html", "../x", "../../../x", "/x/./y/../z", "?page=2", "", "#s", "x#s", "https://h.example", "/für", "x y", "mailto:a@b.c", "javascript:void(0)", "//o.example/z", "1:2", "/%zz"]
#: cfg, attempts, delay ms, cap ms, factor.
RETRY_CONFIGS = [("default", 3, 1000, 3000, 1.0), ("flat", 3, 100, 3000, 0.0), ("steep", 3, 100, 3000, 3.0), ("capped", 4, 1000, 3000, 2.0), ("slow", 6, 250, 60000, 1.5)]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def page_resources(spark, sf_dir):
    return extract.resources(pages(spark, sf_dir)).select("page_id", "pos", "tag", "source_url")


def resource_attributes(spark, sf_dir):
    found = extract.resources(tables.asset_pages(spark, sf_dir)).filter("tag = 'link'")
    return found.select("page_id", F.try_element_at(extract.attribute_map(F.col("attrs")), F.lit("rel")).alias("rel"), F.size("attrs").cast("long").alias("n_attrs"))


def resource_counts(spark, sf_dir):
    found = extract.marked(pages(spark, sf_dir))
    of = lambda page: F.size(F.filter("found", lambda r: (r["tag"] == "a") == page)).cast("long")
    return found.select("page_id", of(F.lit(True)).alias("n_links"), of(F.lit(False)).alias("n_assets"))


def url_parts(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.parts(F.col("url")).alias("p")).select("page_id", "p.scheme", "p.host", "p.path", "p.query", "p.fragment")


def page_links(spark, sf_dir):
    return extract.links(pages(spark, sf_dir)).select("page_id", "pos", "link_url")


def external_refs_dropped(spark, sf_dir):
    found = extract.resolved(extract.resources(tables.asset_pages(spark, sf_dir)))
    return found.groupBy("page_id").agg(F.count_if("kept").alias("kept"), F.count_if(F.col("dropped") == "external").alias("external"), F.count_if(F.col("dropped") == "invalid").alias("invalid"))


def resolve_refs(spark, sf_dir):
    refs = F.explode(F.array(*map(F.lit, REFS))).alias("source_url")
    found = extract.resolved(pages(spark, sf_dir).select("page_id", "url", F.lit("a").alias("tag"), refs))
    return found.select("page_id", F.col("source_url").alias("ref"), "kept", F.when(F.col("kept"), F.col("target")).alias("abs_url"))


def page_save_path(spark, sf_dir):
    return saving.with_page_path(pages(spark, sf_dir)).select("page_id", "save_path")


def link_save_path(spark, sf_dir):
    return extract.links(tables.asset_pages(spark, sf_dir)).select("page_id", "pos", saving.link_path(F.col("abs")).alias("save_path"))


def save_collisions(spark, sf_dir):
    return saving.collisions(pages(spark, sf_dir))


def saved_pages(spark, sf_dir):
    placed = saving.with_page_path(pages(spark, sf_dir)).withColumn("host", urls.parts(F.col("url"))["host"])
    return saving.last_writers(placed.select("page_id", "host", "save_path"), "page_id")


def relative_links(spark, sf_dir):
    found = extract.links(pages(spark, sf_dir))
    own, to = saving.page_path(urls.parts(F.col("url"))), saving.link_path(F.col("abs"))
    return found.select("page_id", "pos", paths.relative_url(own, to).alias("rel_url"))


def asset_rows(spark, sf_dir):
    found = extract.assets(tables.asset_pages(spark, sf_dir))
    return found.select("page_id", "tag", "asset_kind", "asset_url", saving.asset_path(F.col("abs")).alias("save_path"))


def colliding_paths(spark, sf_dir):
    return saving.collisions(tables.versioned_pages(spark, sf_dir))


def colliding_winners(spark, sf_dir):
    placed = saving.with_page_path(tables.versioned_pages(spark, sf_dir)).withColumn("host", urls.parts(F.col("url"))["host"])
    return saving.last_writers(placed.select("page_id", "host", "save_path"), "page_id")


def saved_files(spark, sf_dir):
    """Writes the pages as files and reads what then lies there."""
    folder = scratch(spark, "saved-files")
    placed = saving.with_page_path(tables.versioned_pages(spark, sf_dir)).withColumn("host", urls.parts(F.col("url"))["host"])
    done = sinks.save_files(placed.select("host", "save_path", F.col("html").alias("content"), "page_id"), folder, "page_id")
    done = materialize(done, "saved")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    found = there.select(F.substring_index("path", "/p/", -1).alias("name"), F.col("length").alias("n_bytes"), F.md5("content").alias("md5"))
    return found.join(done.select(F.substring_index("save_path", "/p/", -1).alias("name"), "skipped_on"), "name", "left")


def fetch_errors(spark, sf_dir):
    tries = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 13 != 0, F.element_at(F.array(*map(F.lit, (200, 204, 301, 404, 500))), (F.col("event_id") % 5 + 1).cast("int")))
    return tries.select("event_id", fetch.error_class(status, F.col("event_id") % 17 == 0).alias("error"))


def asset_occurrences(spark, sf_dir):
    return extract.occurrences(extract.assets(tables.asset_pages(spark, sf_dir)))


def asset_url_map(spark, sf_dir):
    return extract.occurrences_by_url(extract.assets(tables.asset_pages(spark, sf_dir)))


def page_children(spark, sf_dir):
    found = extract.children(tables.asset_pages(spark, sf_dir))
    return found.groupBy("src_url", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst_url").alias("n_distinct"))


def seen_dedup(spark, sf_dir):
    return stream.urls_of(pages(spark, sf_dir)).distinct()


def frontier_limit(spark, sf_dir):
    own = pages(spark, sf_dir)
    found = extract.links(own).select(F.col("link_url").alias("url"), "page_id", F.col("pos").alias("place"))
    items = own.select("url", "page_id", F.lit(-1).cast("long").alias("place")).union(found)
    return frontier.limited(frontier.first_of_each(items, "url", ["page_id", "place"]), ["page_id", "place"], FRONTIER_LIMIT).select("url", "rank")


def site_edges(spark, sf_dir) -> DataFrame:
    return materialize(extract.children(tables.site_pages(spark, sf_dir)), "site-edges")


def crawl_bfs(spark, sf_dir):
    found = frontier.walk(site_edges(spark, sf_dir), tables.seeds(spark, "https://site.example/p/0"))
    return found.select("url", F.col("level").cast("long").alias("level"))


def crawl_bfs_limited(spark, sf_dir):
    found = frontier.crawl(site_edges(spark, sf_dir), tables.seeds(spark, "https://site.example/p/0"), PAGE_LIMIT)
    return found.select("url", "rank")


def fetch_left_join(spark, sf_dir):
    own = pages(spark, sf_dir)
    asked = stream.urls_of(own).distinct()
    return fetch.fetched(asked, own, SIZE_LIMIT).select("url", "skipped_on", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("n_bytes"))


def size_guard(spark, sf_dir):
    return fetch.guarded(pages(spark, sf_dir), SIZE_LIMIT)


def fanin_union(spark, sf_dir):
    own = tables.asset_pages(spark, sf_dir)
    kept = own.select("page_id", F.lit("page").alias("kind"), F.when(F.octet_length("html") > SIZE_LIMIT, "download").alias("skipped_on"))
    found = extract.assets(own).select("page_id", F.lit("asset").alias("kind"), F.lit(None).cast("string").alias("skipped_on"))
    return frontier.summary(frontier.merged([kept, found]))


def crawl_stats(spark, sf_dir):
    return metrics.stats(tables.crawl_log(spark, sf_dir))


def crawl_stats_by_user(spark, sf_dir):
    return metrics.stats(tables.crawl_log(spark, sf_dir), "user_id")


def stats_line(spark, sf_dir):
    return metrics.report(crawl_stats(spark, sf_dir))


def retry_schedule(spark, sf_dir):
    return retry.schedule(spark.createDataFrame(RETRY_CONFIGS, "cfg string, attempts int, delay_ms long, max_delay_ms long, factor double"))


def retry_outcome(spark, sf_dir):
    tries = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), (F.col("value") < 50).alias("retryable"))
    return retry.outcomes(tries, 3)


def rewrite_map(spark, sf_dir):
    return saving.rewrite_map(pages(spark, sf_dir)).select("page_id", "pos", "old_url", "new_url")


def rewrite_html(spark, sf_dir):
    return saving.rewritten(pages(spark, sf_dir)).select("page_id", "html")


def stream_page_links(spark, sf_dir):
    return stream.drain(stream.page_links(stream.stream_table(spark, sf_dir, "pages")), "stream-links")


def stream_seen_dedup(spark, sf_dir):
    return stream.drain(stream.seen_dedup(stream.urls_of(stream.stream_table(spark, sf_dir, "pages"))), "stream-seen")


def stream_stats(spark, sf_dir):
    last: list[DataFrame] = []

    def keep(batch: DataFrame) -> None:
        last[:] = [materialize(batch, "stream-stats")]

    stream.running_stats(stream.stream_table(spark, sf_dir, "events"), keep)
    return last[0] if last else metrics.stats(tables.crawl_log(spark, sf_dir).limit(0))


def stream_frontier(spark, sf_dir):
    items = stream.stream_table(spark, sf_dir, "pages").select("url", F.lit("page").alias("kind"), F.col("page_id").alias("ord"))
    return stream.StreamFrontier(spark, FRONTIER_LIMIT).run(items).select("url")


QUERIES = {
    f.__name__: f
    for f in (page_resources, resource_attributes, resource_counts, url_parts, page_links, external_refs_dropped, resolve_refs, page_save_path, link_save_path, save_collisions, saved_pages, colliding_paths, colliding_winners, saved_files, fetch_errors, asset_occurrences, relative_links, asset_rows, asset_url_map, page_children, seen_dedup, frontier_limit, crawl_bfs, crawl_bfs_limited, fetch_left_join, size_guard, fanin_union, crawl_stats, crawl_stats_by_user, stats_line, retry_schedule, retry_outcome, rewrite_map, rewrite_html, stream_page_links, stream_seen_dedup, stream_stats, stream_frontier)
}
