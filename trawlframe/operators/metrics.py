"""Crawl statistics: one aggregation over a log of fetches, globally or by group.

A log has ok, ts, seq (breaks ties of ts), response_us, links, assets, bytes, error, active_workers, total_workers.
All aggregates combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(log: DataFrame, *by: str) -> DataFrame:
    """Counters, times, averages and rates. The average is a whole number of microseconds; rates are 0 where there is nothing to divide by."""
    at = F.struct("ts", "seq")
    failed = ~F.col("ok")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    found = log.groupBy(*by).agg(
        F.count_if("ok").alias("pages_crawled"),
        F.count_if(failed).alias("pages_failed"),
        total("links").alias("links_discovered"),
        total("assets").alias("assets_found"),
        total("bytes").alias("bytes_downloaded"),
        F.min("ts").alias("start_time"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_crawl_time"),
        F.count("response_us").alias("response_count"),
        total("response_us").alias("total_response_us"),
        F.max_by(F.when(failed, F.col("error")), F.when(failed, at)).alias("last_error"),
        F.max(F.when(failed, F.col("ts"))).alias("last_error_time"),
        F.count_if(failed).alias("error_count"),
        F.max_by("active_workers", at).alias("active_workers"),
        F.max_by("total_workers", at).alias("total_workers"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("uptime_us"),
    )
    average = F.when(F.col("response_count") > 0, F.expr("total_response_us div response_count")).otherwise(F.lit(0).cast("long"))
    tries = F.col("pages_crawled") + F.col("pages_failed")
    return (
        found.withColumn("avg_response_us", average)
        .withColumn("success_rate", F.coalesce(F.try_divide(F.col("pages_crawled").cast("double"), tries) * 100, F.lit(0.0)))
        .withColumn("crawl_rate", F.coalesce(F.try_divide(F.col("pages_crawled").cast("double"), F.col("uptime_us") / 1e6), F.lit(0.0)))
        .drop("total_response_us")
    )


def duration_text(us: Column) -> Column:
    """Microseconds as text like 1h2m3.5s."""
    number = lambda x, scale: F.regexp_replace(F.format_string("%.6f", x / F.lit(float(scale))), r"\.?0+$", "")
    hours, minutes = F.floor(us / 3_600_000_000), F.floor(us % 3_600_000_000 / 60_000_000)
    long = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(""), F.when((hours > 0) | (minutes > 0), F.concat(minutes.cast("string"), F.lit("m"))).otherwise(""), number(us % 60_000_000, 1e6), F.lit("s"))
    return F.when(us == 0, "0s").when(us < 1000, F.concat(us.cast("string"), F.lit("µs"))).when(us < 1_000_000, F.concat(number(us, 1e3), F.lit("ms"))).otherwise(long)


#: The report's fixed form.
REPORT = "Pages: %d crawled, %d failed | Links: %d | asset: %d | Bytes: %d | Workers: %d/%d | Uptime: %s | Avg Response: %s"


def report(found: DataFrame) -> DataFrame:
    """One line for each row of stats()."""
    counters = ["pages_crawled", "pages_failed", "links_discovered", "assets_found", "bytes_downloaded", "active_workers", "total_workers"]
    return found.select(F.format_string(REPORT, *counters, duration_text(F.col("uptime_us")), duration_text(F.col("avg_response_us"))).alias("line"))
