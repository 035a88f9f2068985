"""Exact de-duplication by content-defined chunk recipes (DataFrame functions only).

A text is normalised, cut where its content says so, and from then on stands for itself only as the
ordered list of its chunks' identifiers: the text is read once and never shuffled.

Null text counts as empty, and empty texts are equal to each other. Rows that share a doc_id are
separate rows: of equal ones the first written stays. A null doc_id sorts after all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table
from .common import BLANKS, materialize, numbered

#: A chunk has at least MIN_CHUNK characters and at most MAX_CHUNK, but for a text's last one.
MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: A cut needs three characters of these classes in a row: an eighth of Latin-1 each, chosen by code point.
_CLASSES = tuple("".join(f"\\x{cp:02X}" for cp in range(0x20, 0x100) if cp * 5 % 8 == k) for k in (1, 4, 6))


def normalized(text: Column) -> Column:
    """Each run of blanks becomes one space; null becomes ''. Single spaces are left untouched, which is most of them."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[\\x09-\\x0D][{BLANKS}]*|\\x20[{BLANKS}]+", " ")


def chunks(text: Column) -> Column:
    """Content-defined chunks of a text; joined they give the text back."""
    window = "".join(f"[{c}]" for c in _CLASSES)
    pattern = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?(?<={window})|.{{{MAX_CHUNK}}}|.+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, key=F.xxhash64, uid: str | None = None) -> DataFrame:
    """uid, doc_id, text_sha256 and recipe: the ordered (key, bytes, SHA-256) of each chunk.

    `key` maps a chunk to its 64-bit key (tests pass a weak one to force collisions); `uid` names a row number
    that docs already have.
    """
    number = F.col(uid) if uid else F.monotonically_increasing_id()
    base = docs.select(number.alias("uid"), "doc_id", normalized(F.col("text")).alias("t"))
    entry = lambda c: F.struct(key(c).cast("long").alias("h"), F.octet_length(c).alias("n"), F.unhex(F.sha2(c, 256)).alias("sha"))
    return base.select("uid", "doc_id", F.sha2("t", 256).alias("text_sha256"), F.transform(chunks(F.col("t")), entry).alias("recipe"))


def identified(recipe_table: DataFrame) -> DataFrame:
    """Replace each chunk by its verified identifier: the 64-bit key, with the SHA-256 beside it where the key is shared by different chunks."""
    store = recipe_table.select(F.explode("recipe").alias("p")).select("p.*").distinct()
    shared = materialize(store.groupBy("h").count().filter("count > 1").select("h"), "chunk-collisions")
    plain = recipe_table.select("uid", "doc_id", "text_sha256", F.transform("recipe", lambda p: F.struct(p["h"].alias("h"), F.lit(None).cast("binary").alias("sha"))).alias("ids"))
    if shared.isEmpty():
        return plain
    touched = recipe_table.select("uid", F.posexplode("recipe").alias("pos", "p"))
    marked = touched.join(shared.withColumn("clash", F.lit(True)), F.col("p.h") == F.col("h"), "left")
    entry = F.struct("pos", F.struct(F.col("p.h").alias("h"), F.when(F.col("clash"), F.col("p.sha")).alias("sha")).alias("id"))
    exact = marked.groupBy("uid").agg(F.array_sort(F.collect_list(entry)).alias("l"))  # as many entries as the text has chunks
    exact = exact.select("uid", F.transform("l", lambda x: x["id"]).alias("exact"))
    return plain.join(exact, "uid", "left").select("uid", "doc_id", "text_sha256", F.coalesce("exact", "ids").alias("ids"))


def decide(docs: DataFrame, key=F.xxhash64, uid: str | None = None) -> DataFrame:
    """One row per document: uid, doc_id, keep_id, group_size, kept, text_sha256.

    The recipe groups are written before they meet the rows again, so that both sides of that join are
    exchanges and adaptive execution can split a group of copies that holds a third of the corpus.
    """
    rows = materialize(identified(materialize(recipes(docs, key, uid), "chunk-recipes")), "chunk-ids")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("uid").alias("uid")))
    groups = materialize(rows.groupBy("ids").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    return rows.join(groups, "ids").select("uid", "doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    number = "__row_of_exact_dedup"
    own = numbered(docs, number)
    kept = decide(own, uid=number).filter("kept").select(F.col("uid").alias(number))
    return own.join(kept, number, "left_semi").drop(number)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents")).drop("uid")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS rn, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY n) AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       row_number() OVER (PARTITION BY n ORDER BY doc_id NULLS LAST, rn) = 1 AS kept,
       sha256(n) AS text_sha256
FROM t
"""
