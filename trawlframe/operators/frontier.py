"""The crawl frontier: de-duplication, page limit, breadth-first walk, merge, termination."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Batches, materialize, scratch


@contextmanager
def dealt(edges: DataFrame, by: str) -> Iterator[DataFrame]:
    """edges written once, in buckets by a column and sorted by it, for as long as they are in use: a join on that column moves the other side only."""
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"trawlframe_edges_{uuid.uuid4().hex}"
    edges.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", scratch(spark, "edges")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def first_of_each(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of items with the same key, the first by `order`: what a seen-set lets through. Combined before the shuffle."""
    rest = [c for c in items.columns if c != key and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("best")
    return items.groupBy(key).agg(best).select(key, *[F.col(f"best.{c}").alias(c) for c in [*order, *rest]])


def unseen(items: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    return items.join(seen.select(key), key, "left_anti")


def ranked(items: DataFrame, order: list[str], rank: str) -> DataFrame:
    """Adds a rank from 0 in the given order: ranges are sorted apart and counted, so that no task holds all rows."""
    sliced = items.repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialize(sliced.withColumn("__slice", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranks")
    sizes = {r[0]: r[1] for r in held.groupBy("__slice").count().collect()}  # one number a partition
    before, total = {}, 0
    for k in sorted(sizes):
        before[k], total = total, total + sizes[k]
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else None
    number = base[F.col("__slice")] + F.col("__row") if before else F.lit(0)
    return held.withColumn(rank, number.cast("long")).drop("__slice", "__row")


#: Up to here a limit is taken by keeping each partition's best; a larger one by ranks, so that no task holds it all.
SMALL_LIMIT = 100_000


def first_n(items: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n items in order."""
    if n <= SMALL_LIMIT:
        return items.orderBy(*order).limit(max(n, 0))
    return ranked(items, order, "__place").filter(F.col("__place") < n).drop("__place")


def limited(items: DataFrame, order: list[str], limit: int, rank: str = "rank") -> DataFrame:
    """The first `limit` items in order, ranked from 0."""
    return ranked(first_n(items, order, limit), order, rank)


def walk(edges: DataFrame, seeds: DataFrame, max_levels: int | None = None) -> DataFrame:
    """url, kind and level of all that is reached from seeds (url); edges are src_url, kind, dst_url.

    A level is one join of the frontier with the edges and one anti-join with what was seen. Levels are batches of one written table, so
    that plans stay short and lost executors cost a level; the edges are written once, dealt and sorted by src_url. Only pages are followed. Ends when a level finds nothing.
    """
    spark = edges.sparkSession
    levels = Batches(spark, "levels", "url string, kind string, level int")
    frontier, level = levels.put(seeds.select("url").distinct().select("url", F.lit("page").alias("kind"), F.lit(0).alias("level")), 0), 0
    with dealt(edges, "src_url") as edges:
        while max_levels is None or level < max_levels:
            level += 1
            pages = frontier.filter("kind = 'page'").select(F.col("url").alias("src_url"))
            found = edges.join(pages, "src_url").groupBy(F.col("dst_url").alias("url")).agg(F.max("kind").alias("kind"))  # a page before an asset
            new = unseen(found, levels.upto(level))
            frontier = levels.put(new.select("url", "kind", F.lit(level).alias("level")), level)
            if frontier.isEmpty():
                break
    return levels.upto(level + 1)


def crawl(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """url, kind, level and rank of what a crawl of an edge table accepts; edges are src_url, kind, kind_rank, pos, dst_url."""

    with dealt(edges, "src_url") as laid:

        def expand(accepted: DataFrame) -> DataFrame:
            parents = accepted.filter("kind = 'page'").select(F.col("url").alias("src_url"), F.col("rank").alias("parent"))
            return laid.join(parents, "src_url").select(F.col("dst_url").alias("url"), "parent", "kind_rank", "pos", "kind")

        return grow(expand, seeds, limit)


def grow(expand: Callable[[DataFrame], DataFrame], seeds: DataFrame, limit: int, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """url, kind, level and rank of what a crawl with one worker a stage accepts, in its order, with at most `limit` pages.

    `expand` turns what a level accepted (url, kind, rank, level) into candidates (url, parent, kind_rank, pos, kind). Order:
    level, rank of the parent, links before assets, position. A page beyond the limit is refused but stays seen, so
    that an asset of that URL is refused later too. Ends when a level brings nothing new. `progress` is told of the pages and assets accepted so far after each level.
    """
    order = ["parent", "kind_rank", "pos"]
    spark = seeds.sparkSession
    seed = first_of_each(seeds.select("url", F.lit(0).alias("pos")), "url", ["pos"]).drop("pos")
    done = Batches(spark, "accepted", "url string, kind string, level int, rank long")
    seen = Batches(spark, "found", "url string, kind string, parent long, kind_rank int, pos long")
    accepted = done.put(limited(seed.select("url", F.lit("page").alias("kind"), F.lit(0).alias("level")), ["url"], limit), 0)
    seen.put(accepted.select("url", "kind", *[F.lit(0).cast(t).alias(c) for c, t in zip(order, ("long", "int", "long"))]), 0)
    pages = total = accepted.count()
    level = 0
    while True:
        level += 1
        found = expand(accepted).select("url", *order, "kind")
        new = seen.put(unseen(first_of_each(found, "url", order), seen.upto(level)).select("url", "kind", F.col("parent").cast("long"), F.col("kind_rank").cast("int"), F.col("pos").cast("long")), level)
        if new.isEmpty():
            return done.upto(level).select("url", "kind", "level", "rank")
        links = first_n(new.filter("kind = 'page'"), order, limit - pages)
        taken = links.unionByName(new.filter("kind <> 'page'"))
        placed = ranked(taken, order, "__rank").select("url", "kind", F.lit(level).alias("level"), (F.col("__rank") + total).alias("rank"))
        accepted = done.put(placed, level)
        counts = {r[0]: r[1] for r in accepted.groupBy("kind").count().collect()}
        total, pages = total + sum(counts.values()), pages + counts.get("page", 0)
        if progress:
            progress(pages, total - pages)


def merged(streams: list[DataFrame]) -> DataFrame:
    """All rows of all inputs, in no order."""
    return reduce(DataFrame.unionByName, streams)


def summary(items: DataFrame) -> DataFrame:
    """kind and n, skipped items included, and how many of them were skipped."""
    return items.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("skipped_on").alias("skipped"))
