"""Structured Streaming forms of extraction, de-duplication, statistics and the frontier."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, frontier, metrics
from ..sources.tables import log_of
from ..storage import Batches, discard, materialize, scratch


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A table's files as a stream; maxFilesPerTrigger holds a burst back.

    The path is a pattern, since a stream takes a plain one for a folder and a table may be a single file.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/{name}.parque[t]")


_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str) -> Iterator[None]:
    """Queries that start inside keep their state in that store; the session's setting is as before afterwards."""
    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, provider)
    try:
        yield
    finally:
        spark.conf.set(_STATE_STORE, before)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Append the stream's rows to files until what is there is used up, and read them back. State, if any, is kept in RocksDB."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    with state_store(spark, ROCKS_DB):
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def drain_by_batch(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None], mode: str, path: str | None = None) -> None:
    """Hand each micro-batch to `each`; with a path of an earlier run, from where that one stopped."""
    path = path or scratch(stream.sparkSession, name)
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def page_links(pages: DataFrame) -> DataFrame:
    """Links of a stream of pages; stateless."""
    return extract.links(pages).select("page_id", "pos", "link_url")


def seen_dedup(urls: DataFrame) -> DataFrame:
    """Each URL of a stream once, ever: the state grows with the number of different URLs, so start the query with state_store(RocksDB), as drain() does."""
    return urls.select("url").dropDuplicates(["url"])


def running_stats(events: DataFrame, keep: Callable[[DataFrame], None]) -> None:
    """Statistics of all events so far after each batch, handed to keep."""
    drain_by_batch(metrics.stats(log_of(events)), "stream-stats", lambda batch, _: keep(batch), "complete")


class StreamFrontier:
    """A frontier over micro-batches: a URL is accepted once, pages up to a limit; accepted and seen URLs are files.

    Each batch's files carry its number and are overwritten when a failed batch is run again. With the path of an earlier
    frontier, its checkpoint included, a new one goes on where that one stopped.
    """

    ACCEPTED = "url string, kind string, ord long"

    def __init__(self, spark: SparkSession, limit: int, path: str | None = None):
        self.spark, self.limit = spark, limit
        self.path = path or scratch(spark, "frontier")
        self.seen = Batches(spark, "seen", "url string", f"{self.path}/seen")
        self.accepted = Batches(spark, "accepted", self.ACCEPTED, f"{self.path}/accepted")

    def accept(self, items: DataFrame, batch: int) -> None:
        """items: url, kind, ord."""
        new = frontier.unseen(frontier.first_of_each(items, "url", ["ord"]), self.seen.upto(batch))
        new = materialize(new, "new-urls")
        left = self.limit - self.accepted.upto(batch).filter("kind = 'page'").count()
        pages = new.filter("kind = 'page'").orderBy("ord").limit(max(left, 0))
        self.accepted.put(pages.unionByName(new.filter("kind <> 'page'")).select("url", "kind", "ord"), batch)
        self.seen.put(new.select("url"), batch)
        discard(new)

    def run(self, items: DataFrame) -> DataFrame:
        """All that was accepted up to the end of this run."""
        drain_by_batch(items, "stream-frontier", self.accept, "append", f"{self.path}/run")
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/accepted")
        there = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        return self.accepted.upto(10**9) if there else self.accepted.upto(0)


def urls_of(pages: DataFrame) -> DataFrame:
    """Every page's own URL and its links."""
    return pages.select("url").union(extract.links(pages).select(F.col("link_url").alias("url")))
