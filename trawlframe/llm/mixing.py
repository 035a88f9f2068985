"""Mixing sources to target weights by temperature (DataFrame functions only).

Token shares of the sources are raised to an exponent: 1 keeps them, 0 makes them equal. The exponent is bisected, in steps of
1 / STEPS, to the smallest one at which no source is repeated more than allowed; with a target entropy, to the largest one at which the
mixture has it, unless the repetition limit, which always holds, asks for a larger one. The weights then become token quotas of a budget, and each source fills its quota with
permutations of its documents: whole ones, then the beginning of one more, cut into blocks of equal tokens.

Tokens are words. Null text has none; a source without tokens gets no quota. A null source is a source. Rows
that share a doc_id are separate rows. Ties in a permutation go by doc_id, then row. An empty table, or one without any word, has an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import table
from .common import WORD, materialize, numbered

STEPS = 1024
#: Exponents that one pass over the sources compares.
FAN = 16
#: Rows of a permutation that one task sums up, about, in up to so many parts of a source. A part of more than CROWDED times that has a repeated
#: or null doc_id and is split by row.
PART_ROWS, MAX_PARTS, CROWDED = 1_000, 20_000, 8
SEED = "mix"
#: The production mixture: as many tokens as the corpus has, no source more than twice.
BUDGET_SHARE, MAX_REPEATS, BLOCK_TOKENS = 1.0, 2.0, 65_536


def key_of(source: Column) -> Column:
    """A text that is never null: '' for a null source, '=' before all others."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def sources_of(sized: DataFrame) -> DataFrame:
    """src, n_docs and total (tokens) of each source that has tokens."""
    return sized.groupBy("src").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("total")).filter("total > 0")


def bisect_exponent(sources: DataFrame, budget: int, max_repeats: float, target_entropy: float | None = None) -> int:
    """The exponent in units of 1 / STEPS. FAN - 1 candidates are judged in a pass, and a few numbers come to the driver."""
    whole = sources.agg(F.sum("total")).first()[0] or 0
    if budget > max_repeats * whole:
        raise ValueError("the budget exceeds what the repetition limit allows at any exponent")

    def judged(candidates: list[int]) -> dict[int, tuple[bool, bool]]:
        """Whether the limit holds at a candidate, and whether the entropy has fallen below the target there."""
        rows = sources.select(F.col("total").cast("double").alias("t"), F.explode(F.array(*[F.lit(k) for k in candidates])).alias("k"))
        raised = F.exp(F.col("k") / STEPS * F.log("t"))
        stats = rows.groupBy("k").agg(F.sum(raised).alias("z"), F.sum(raised * F.col("k") / STEPS * F.log("t")).alias("zl"), F.max(raised / F.col("t")).alias("worst"))
        return {k: (budget * worst / z <= max_repeats, math.log(z) - zl / z < (target_entropy or 0.0)) for k, z, zl, worst in stats.collect()}

    def first(which: int, high: int) -> int:
        """The smallest exponent at which the question is answered with yes; high, if there is none below it."""
        low = -1  # low says no, high yes
        while high - low > 1:
            candidates = sorted({low + (high - low) * i // FAN for i in range(1, FAN)} - {low, high}) or [low + 1]
            said = judged(candidates)
            low = max([low, *(k for k in candidates if not said[k][which])])
            high = min([high, *(k for k in candidates if said[k][which])])
        return high

    repeats = first(0, STEPS)
    return repeats if target_entropy is None else max(repeats, first(1, STEPS + 1) - 1, 0)


def mix(docs: DataFrame, budget_share: float = BUDGET_SHARE, max_repeats: float = MAX_REPEATS, target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS, uid: str | None = None) -> DataFrame:
    """One row per use of a document: uid, doc_id, source, epoch, tokens, start (tokens of its epoch before it), block.

    No source is used more than max_repeats times over, so a row has that many uses at most; target_entropy is in nats; the
    budget is a share of the corpus's tokens.
    """
    if uid is None:
        docs, uid = numbered(docs, "__row_of_mixing"), "__row_of_mixing"
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select(F.col(uid).alias("uid"), "doc_id", "source", key_of(F.col("source")).alias("src"), tokens.alias("tokens")), "token-counts")
    sources = materialize(sources_of(sized), "source-totals")
    whole = sources.agg(F.sum("total")).first()[0] or 0
    budget = int(budget_share * whole)
    k = bisect_exponent(sources, budget, max_repeats, target_entropy) if whole else STEPS
    raised = F.exp(F.lit(k) / STEPS * F.log(F.col("total").cast("double")))
    z = sources.agg(F.sum(raised)).first()[0] or 1.0
    quota = F.floor(F.lit(float(budget)) * raised / F.lit(z) + 0.5).cast("long")
    quotas = materialize(sources.select("src", "total", quota.alias("quota"), F.least(F.ceil(F.col("n_docs") / PART_ROWS), F.lit(MAX_PARTS)).alias("parts"), "n_docs"), "source-quotas")
    return permuted(sized, quotas, block_tokens)


def permuted(sized: DataFrame, quotas: DataFrame, block_tokens: int) -> DataFrame:
    """Fill each source's quota. The prefix sums are taken over parts of the permutation first, then inside each part, so that a large source spreads over many tasks."""
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("total")))).alias("epoch")
    used = sized.join(quotas.filter("quota > 0"), "src").select("uid", "doc_id", "source", "src", "tokens", "total", "quota", "parts", "n_docs", epochs)
    order = F.md5(F.concat_ws(":", F.lit(SEED), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    share = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    used = used.withColumn("order", order).withColumn("part", F.floor(share * F.col("parts") / F.lit(float(1 << 32))))
    used = materialize(used, "permutations")
    of = ["src", "epoch", "part", "sub"]
    held = used.groupBy(*of[:3]).agg(F.count(F.lit(1)).alias("n"), F.first("n_docs").alias("n_docs"), F.first("parts").alias("parts"))
    crowded = held.filter(F.col("n") > CROWDED * F.greatest(F.lit(PART_ROWS), F.col("n_docs") / F.col("parts")))
    crowded = materialize(crowded.select(*of[:3], F.least(F.ceil(F.col("n") / PART_ROWS), F.lit(MAX_PARTS)).alias("subs")), "crowded-parts")
    if crowded.isEmpty():
        used = used.withColumn("sub", F.lit(0).cast("long"))
    else:
        used = used.join(crowded, of[:3], "left").withColumn("sub", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("subs")), F.lit(0).cast("long"))).drop("subs")
    earlier = Window.partitionBy("src", "epoch").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    sums = used.groupBy(*of).agg(F.sum("tokens").alias("held")).select(*of, F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*of).orderBy("order", "doc_id", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = used.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(materialize(sums, "part-sums"), of)
    placed = placed.withColumn("start", F.col("base") + F.col("inside")).filter(F.col("epoch") * F.col("total") + F.col("start") < F.col("quota"))
    return placed.select("uid", "doc_id", "source", "epoch", "tokens", "start", F.expr(f"start div {int(block_tokens)}").alias("block"))


def mixed(docs: DataFrame, budget_share: float, max_repeats: float) -> DataFrame:
    """The documents of a mixture without repetition of its own choosing: each use of a document is a row with docs' columns."""
    name = "__row_of_mixing"
    own = numbered(docs, name)
    uses = mix(own, budget_share, max_repeats, uid=name).select(F.col("uid").alias(name))
    return own.join(uses, name).select(*docs.columns)


def op7_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("uid")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM documents),
sources AS (SELECT src, CAST(sum(tokens) AS BIGINT) AS total FROM sized GROUP BY src HAVING sum(tokens) > 0),
budget AS (SELECT floor({BUDGET_SHARE} * sum(total)) AS b FROM sources),
raised AS (SELECT k, src, total, exp(k / {STEPS}.0 * ln(total)) AS r FROM sources, range(0, {STEPS} + 1) g(k)),
fits AS (SELECT k, sum(r) AS z FROM raised GROUP BY k HAVING (SELECT b FROM budget) * max(r / total) / sum(r) <= {MAX_REPEATS}),
quotas AS (
  SELECT src, total, CAST(floor((SELECT b FROM budget) * r / z + 0.5) AS BIGINT) AS quota
  FROM raised JOIN fits USING (k) WHERE k = (SELECT min(k) FROM fits)),
used AS (
  SELECT doc_id, source, src, tokens, total, quota, unnest(range(0, CAST(floor((quota - 1) / total) AS BIGINT) + 1)) AS epoch
  FROM sized JOIN quotas USING (src) WHERE quota > 0),
placed AS (
  SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY src, epoch ORDER BY md5('{SEED}:' || epoch || ':' || doc_id), doc_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM used)
SELECT doc_id, source, epoch, tokens, start, CAST(start // {BLOCK_TOKENS} AS BIGINT) AS block
FROM placed WHERE epoch * total + start < quota
"""
