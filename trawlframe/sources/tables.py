"""Tables that stand in for a site: derived pages, link graphs and crawl logs, by formulas that SQL shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table


def seeds(spark: SparkSession, *urls: str) -> DataFrame:
    """Start URLs as they are, fragment included."""
    return spark.createDataFrame([(u,) for u in urls], "url string")


def asset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with markup of every kind of reference added at the end."""
    extra = F.expr("""concat('<img src="/img/', page_id % 7, '.png"><link rel=stylesheet href="../css/', page_id % 3, '.css?v=1#x">',
      '<script src="https://cdn.example.org/', page_id % 5, '.js"></script><script src="app.js"></script>',
      '<a href="#sec">s</a><a href="?page=2">n</a><a href="../up/x.html#f">u</a><a href="mailto:a@b.c">m</a><a name="n">x</a><a href="">e</a>')""")
    return spread(table(spark, sf_dir, "pages")).withColumn("html", F.concat("html", extra))


def versioned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages of one host under addresses that differ in their queries: forty of them are saved at each path."""
    n = 40
    url = F.concat(F.lit("https://site.example/p/"), (F.col("page_id") / n).cast("long").cast("string"), F.lit("?v="), F.col("page_id").cast("string"))
    return spread(table(spark, sf_dir, "pages")).withColumn("url", url)


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One host whose pages link to each other in cycles."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    n = pages.count()
    html = F.expr(f"""concat('<a href="/p/', (2 * page_id + 1) % {n}, '">', '<a href="/p/', (7 * page_id + 3) % {n}, '">', '<a href="/p/', (2 * page_id + 1) % {n}, '#f">', '<a href="/p/', page_id, '">')""")
    return pages.select("page_id", F.concat(F.lit("https://site.example/p/"), F.col("page_id")).alias("url"), html.alias("html"))


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of fetches."""
    return log_of(table(spark, sf_dir, "events"))


def log_of(events: DataFrame) -> DataFrame:
    ok = F.col("event_type") != "error"
    return events.select(
        ok.alias("ok"),
        "ts",
        F.col("event_id").alias("seq"),
        F.round(F.col("value") * 1000).cast("long").alias("response_us"),
        (F.col("event_id") % 7).alias("links"),
        (F.col("event_id") % 3).alias("assets"),
        F.octet_length("props").cast("long").alias("bytes"),
        F.when(~ok, F.concat(F.lit("failed: "), F.col("event_id"))).alias("error"),
        (F.col("user_id") % 10 + 1).alias("active_workers"),
        F.lit(10).cast("long").alias("total_workers"),
        "user_id",
    )
