"""The corpus pipeline: language ID, line de-duplication, SimHash near-de-duplication, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; run() writes
each result as Parquet and reads it back for the next. All stages but the last return the columns of documents.

In every stage null text counts as empty, rows that share a doc_id are separate rows, ties go to the smallest doc_id (then the
first row, a null doc_id last), extra columns stay as they are, and an empty table gives an empty one. The first stage drops null and empty
texts, as they have no letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlframe.llm import language_id, line_dedup, mixing, packing, simhash
from trawlframe.llm.common import materialize
from trawlframe.storage import release, written

#: Below this score not even the winning language holds most of the weight.
LEAST_SCORE = 0.5
#: Nine tenths of the tokens, no document twice: sources are evened out as far as that allows.
BUDGET_SHARE, MAX_REPEATS = 0.9, 1.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language above the others, go. lang is left as it is. Where no lang is there to learn from, only those without a letter go."""
    names = ("__lang_pred", "__score", "__ambiguous")
    model = language_id.fit(language_id.learnable(docs))
    if model is None:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    judged = language_id.identify(docs, model, names)
    return judged.filter((F.col(names[0]) != language_id.UND) & (F.col(names[1]) >= LEAST_SCORE)).drop(*names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has, or nearly has, go; so does a document that they were all of."""
    return line_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Large sources give way until the token budget is met."""
    return mixing.mixed(docs, BUDGET_SHARE, MAX_REPEATS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    return packing.packed(docs, ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language ID and tokenization are beyond SQL; tests hold a small run against the stages done by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage has written goes when its result is there, and that when the next one's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before, docs)
    return docs
