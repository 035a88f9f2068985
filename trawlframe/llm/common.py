"""What the training-data operators share: row identities, samples, split rules, word rules."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, numbered, shared_dir

__all__ = ["BLANKS", "WORD", "crc_mod", "likely", "materialize", "numbered", "sampled", "shared_dir", "sliced", "small"]

#: The characters that separate words in every operator here.
BLANKS = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANKS}]+"

#: Bits of a filter: so many for each id that it lets through, but never more than MAX_BITS in all (32 MB).
BITS_EACH, MAX_BITS = 16, 1 << 28


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's text form modulo n: the split of rows into learning and held-out ones. A null counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def sampled(df: DataFrame, by: str, bound: int | dict, seed: str) -> DataFrame:
    """About `bound` rows (in expectation; all, if there are fewer) of each value of `by`, chosen by a hash of doc_id.

    A bound for each value can be given as a dict. One count per value goes to the driver, so `by` must be a label or a language.
    """
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    share = F.lit(None).cast("double")
    for value, n in counts.items():
        share = F.when(F.col(by).eqNullSafe(F.lit(value)), F.lit(min(1.0, (bound[value] if isinstance(bound, dict) else bound) / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.filter(draw < share)


#: Numbers that may be sent to all tasks (32 MB); a table of more is joined by a shuffle.
FEW_NUMBERS = 4_000_000


def small(table: DataFrame, numbers: Column | int = 8) -> DataFrame:
    """A written table, marked for broadcast if it holds FEW_NUMBERS or fewer, at so many a row."""
    held = table.agg(F.sum(numbers)).first()[0] if isinstance(numbers, Column) else table.count() * numbers
    return F.broadcast(table) if (held or 0) <= FEW_NUMBERS else table


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id is, or by chance may be, in the written table wanted (id, 64-bit hashes): a bitmap of bounded size goes to all tasks, so that few rows are left to join.

    Join them by an inner join: a semi join would be moved below the filter.
    """
    n = wanted.count()
    bits = min(max(1 << (BITS_EACH * n).bit_length(), 1 << 15), MAX_BITS)
    place = F.pmod(F.col("id"), F.lit(bits))
    bitmaps = wanted.select(place.alias("__at")).groupBy(F.bitmap_bucket_number("__at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__at")).alias("bitmap"))
    # eight bytes of a bitmap are one number, the first byte its highest
    words = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(F.hex(F.substring("bitmap", i * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    met = rows.withColumn("__at", place).withColumn("__bucket", F.bitmap_bucket_number("__at")).join(F.broadcast(bitmaps.select("__bucket", words.alias("__words"))), "__bucket")
    at = F.bitmap_bit_position("__at").cast("int")
    bit = F.lit(56) - F.call_function("shiftright", at % 64, F.lit(3)) * 8 + at % 8
    word = F.get("__words", F.call_function("shiftright", at, F.lit(6)))
    return met.filter(F.call_function("shiftright", word, bit).bitwiseAND(F.lit(1)) == 1).select(*rows.columns)


#: Rows of a batch that a Python worker works on at once.
SLICE_ROWS = 500


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """All rows of Arrow batches, a few at once, so that what a worker makes of them stays small. At the end what it has freed goes back to the system, as workers live on between tasks."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass
