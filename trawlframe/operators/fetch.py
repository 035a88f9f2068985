"""Fetching from a table of pages: size guard, status, and what becomes of what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest content that is fetched.
MAX_FILE_SIZE = 64 << 20


def allowed(content_length: Column, limit: int = MAX_FILE_SIZE) -> Column:
    """The size guard: an unknown or unreadable length is allowed, and so is one that equals the limit."""
    length = content_length.try_cast("bigint")
    return length.isNull() | (length <= limit)


def guarded(pages: DataFrame, limit: int = MAX_FILE_SIZE) -> DataFrame:
    """page_id, n_bytes and whether the guard lets the page through."""
    n = F.octet_length("html").cast("long")
    return pages.select("page_id", n.alias("n_bytes"), allowed(n, limit).alias("allowed"))


def fetched(frontier: DataFrame, pages: DataFrame, limit: int = MAX_FILE_SIZE) -> DataFrame:
    """frontier with content and skipped_on: what is missing or too large is skipped at 'download' but goes on, without content.

    Fetching is an equi-join on the URL; of pages with the same URL the first stands for all (the smallest page_id, a null one last, then the smallest
    html). The pages are found by their keys alone; content is read for those that were asked for.
    """
    key = F.struct(F.col("page_id").isNull().alias("no"), F.col("page_id").alias("id"))
    asked = pages.select("url", "page_id").join(frontier.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.min(key).alias("first"))
    chosen = asked.select(F.col("url").alias("__url"), F.col("first.id").alias("__id"))
    met = pages.join(chosen, (F.col("url") == F.col("__url")) & F.col("page_id").eqNullSafe(F.col("__id")))
    one = met.groupBy("url").agg(F.min("html").alias("content"))
    joined = frontier.join(one, "url", "left")
    ok = F.col("content").isNotNull() & allowed(F.octet_length("content").cast("long"), limit)
    return joined.withColumn("skipped_on", F.when(~ok, "download")).withColumn("content", F.when(ok, F.col("content")))


def error_class(status: Column, cancelled: Column) -> Column:
    """None for a success (status 200 alone), else what went wrong."""
    return F.when(cancelled, "cancelled").when(status.isNull(), "http").when(status != 200, "status")
