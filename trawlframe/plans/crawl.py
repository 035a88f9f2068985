"""A whole crawl: seeds to fetched, parsed, rewritten and saved items, and what became of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CrawlConfig
from ..functions import urls
from ..operators import extract, fetch, frontier, saving
from ..operators.retry import RetryConfig
from ..sources import http, sinks, tables
from ..storage import materialize

Fetcher = Callable[[DataFrame], DataFrame]


def live_fetcher(config: CrawlConfig) -> Fetcher:
    settings = RetryConfig(max_attempts=config.retry_attempts, delay=float(config.retry_delay))
    return lambda asked: http.fetch_live(asked, config.max_concurrent, float(config.timeout), max_file_size=config.max_file_size, config=settings)


def table_fetcher(pages: DataFrame, max_file_size: int = fetch.MAX_FILE_SIZE) -> Fetcher:
    """Fetches from a table of pages (page_id, url, html) instead of the network."""
    return lambda asked: fetch.fetched(asked.select("url"), pages, max_file_size).withColumn("content", F.col("content").cast("binary"))


def collect(spark: SparkSession, config: CrawlConfig, fetcher: Fetcher, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """url, kind, level, rank, content and skipped_on of everything that the crawl accepts; each level is fetched once and written."""
    fetched: list[DataFrame] = []

    def expand(accepted: DataFrame) -> DataFrame:
        got = materialize(fetcher(accepted).select("url", "content", "skipped_on").join(accepted, "url"), "fetched")
        fetched.append(got)
        pages = got.filter("kind = 'page' and content is not null").select(F.col("rank").alias("page_id"), "url", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
        parents = got.select(F.col("url").alias("src_url"), F.col("rank").alias("parent"))
        return extract.children(pages).join(parents, "src_url").select(F.col("dst_url").alias("url"), "parent", "kind_rank", "pos", "kind")

    frontier.grow(expand, tables.seeds(spark, config.url), config.max_count, progress)
    return frontier.merged(fetched)


def placed(items: DataFrame, root_name: str = "") -> DataFrame:
    """Adds host and save_path, and rewrites the links of pages."""
    document = F.make_valid_utf8(F.col("content").cast("string"))
    new = F.when((F.col("kind") == "page") & F.col("content").isNotNull(), F.encode(saving.rewritten_html(F.col("url"), document, root_name), "UTF-8"))
    known = items.withColumn("content", F.coalesce(new, "content")).withColumn("p", urls.parts(F.col("url")))
    path = F.when(F.col("kind") == "page", saving.page_path(F.col("p"))).otherwise(saving.asset_path(F.col("p")))
    return known.withColumn("host", F.col("p.host")).withColumn("save_path", path).drop("p")


def crawl(spark: SparkSession, config: CrawlConfig, fetcher: Fetcher | None = None, root_name: str = "", progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """Crawl, rewrite and save under config.output_dir; url, kind, level, rank, save_path, skipped_stages and skipped_on of every item.

    An item that fails at a stage goes on without content; skipped_on names the last stage that it failed at. `progress` is told of the pages and assets so far, level by level.
    """
    items = materialize(placed(collect(spark, config, fetcher or live_fetcher(config), progress), root_name), "crawled")
    saved = materialize(sinks.save_files(items, config.output_dir), "saved").select("save_path", F.col("skipped_on").alias("at_save"))
    told = items.drop("content").join(saved, "save_path", "left")
    stages = F.array_compact(F.array("skipped_on", "at_save"))
    return told.select("url", "kind", "level", "rank", "save_path", stages.alias("skipped_stages"), F.coalesce("at_save", "skipped_on").alias("skipped_on"))
