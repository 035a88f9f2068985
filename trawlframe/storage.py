"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, if driver and executors are one process (tests).

    Executors of a cluster would each write to their own disk and read part of the rows back, so there it must be set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master {master})")
        found = tempfile.mkdtemp(prefix="trawlframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(path: str) -> None:
    try:
        spark = _written.pop(path)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with the tables of materialize()."""
    path = f"{shared_dir(spark)}/trawlframe/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(lambda: [_remove(p) for p in list(_written)])
    _written[path] = spark
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, keeps column pruning.

    The files stay until discard() or release() removes them, or the Python process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trawlframe_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialize() that nothing will read again; other DataFrames are passed by."""
    for df in tables:
        if getattr(df, "_trawlframe_path", None) in _written:
            _remove(df._trawlframe_path)


def written() -> set[str]:
    """The tables that stand now, for release()."""
    return set(_written)


def release(before: set[str], *keep: DataFrame) -> None:
    """Remove what was written since written() gave `before`, but for the tables in keep."""
    kept = before | {getattr(df, "_trawlframe_path", "") for df in keep}
    for path in [p for p in _written if p not in kept]:
        _remove(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with the column `name`: a row identity that stays the same however often df is read.

    Rows of files are known by two numbers, 64 bits of their file's path and their place in it; anything else is written
    once and then has files.
    """
    identity = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return df.withColumn(name, identity)
    except AnalysisException:
        return materialize(df, "rows").withColumn(name, identity)


class Batches:
    """A table that grows by batches. Each is a folder, written anew if it is written again, and all are read by one scan, so that plans do not grow with them."""

    def __init__(self, spark: SparkSession, name: str, schema: str, path: str | None = None):
        self.spark, self.schema = spark, schema
        self.path = path or scratch(spark, name)

    def put(self, df: DataFrame, number: int) -> DataFrame:
        """Write a batch; returns it as read back."""
        df.write.mode("overwrite").parquet(f"{self.path}/{number:09d}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{number:09d}")

    def upto(self, number: int) -> DataFrame:
        """All batches below `number`, which there have to be."""
        if not number:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        place = F.regexp_extract(F.col("_metadata.file_path"), "/([0-9]{9})/[^/]*$", 1).cast("int")
        return found.filter(place < number)
