"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are one- and two-grams of tokens (runs of letters, digits or marks; lower-cased) and one- to
three-grams of their shapes, where a token that repeats the one before has a shape of its own; their counts are scaled to
length one. Null and empty texts have the bias alone. Without both labels to learn from, scores are 0.5.

Rows of documents that share a doc_id are scored one by one and count once in the sample, by the smallest text; a doc_id that repeats among the labels
counts once, by its larger label. A score of exactly 0.5 is predicted 1. An empty table has an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table
from .common import crc_mod, materialize, sampled

#: Rows of each label to learn from, about; all, if there are fewer. Of their features, so many bytes are learnt from at most.
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 16 << 20
DIM_BITS, EPOCHS = 18, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5

_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x09-\x0d\x20]+")


def _shape(token: bytes) -> int:
    c = token[0]
    if c >= 0x80 or chr(c).isalpha():
        return 1 if token.islower() else 3 if token.isupper() and len(token) > 1 else 2 if chr(c).isupper() else 4
    if chr(c).isdigit():
        return 5
    return 6 if len(token) == 1 else 7


class Tokens(dict):
    """token -> 32-bit hash of its lower-case form, and its shape above; forgets when it has grown too large."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[token] = zlib.crc32(token.lower()) | _shape(token) << 32
        return value


def features(text: str | None, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (distinct, ascending) and values of a whole text; bucket 0 is the bias."""
    found = _TOKEN.findall((text or "").encode())
    n = len(found)
    packed = np.fromiter(map(tokens.__getitem__, found), np.int64, n)
    word, shape = (packed & 0xFFFFFFFF).astype(np.uint32), (packed >> 32).astype(np.uint32)
    if n > 1:
        shape[1:][word[1:] == word[:-1]] = 8
    step = np.uint32(0x01000193)
    grams = [word, word[:-1] * step ^ word[1:] + np.uint32(1), shape + np.uint32(16), shape[:-1] * np.uint32(16) + shape[1:] + np.uint32(4096), shape[:-2] * np.uint32(256) + shape[1:-1] * np.uint32(16) + shape[2:] + np.uint32(65536)]
    at = (np.concatenate(grams) * np.uint32(2654435761)) >> np.uint32(32 - DIM_BITS)
    at, times = np.unique(at, return_counts=True)
    times = times[at > 0].astype(float)
    at = at[at > 0]
    return np.append(0, at).astype(np.int64), np.append(1.0, times / max(np.sqrt((times**2).sum()), 1e-9))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 11) -> np.ndarray:
    """FTRL-proximal with per-coordinate rates over EPOCHS shuffled passes; the labels weigh alike."""
    z, n = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    positive = sum(r[2] for r in rows)
    weight = {1: len(rows) / 2 / max(positive, 1), 0: len(rows) / 2 / max(len(rows) - positive, 1)}
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)).tolist():
            at, x, y = rows[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x * weight[y]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(1 << DIM_BITS))


def fit(rows: DataFrame, label: str, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray | None:
    """Weights learnt from a bounded sample of (doc_id, text, label); its sparse features, of sample_bytes at most, go to the driver."""
    sample = rows.select("text", F.col(label).cast("int").alias("y"), F.xxhash64("doc_id").alias("order"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            found = [features(t.as_py(), tokens) for t in batch.column(0)]
            columns = [pa.array([f[0].astype("<i4").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1), batch.column(2)], ["at", "x", "y", "order"])

    made = materialize(sample.mapInArrow(make, "at binary, x binary, y int, order long"), "label-features")
    found = bounded(made, F.octet_length("at") + F.octet_length("x"), sample_bytes).toPandas().sort_values(["order", "at"])
    rows_ = [(np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4"), y) for a, x, y in zip(found["at"], found["x"], found["y"].tolist())]
    return train(rows_) if found["y"].nunique() == 2 else None


def score(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """doc_id and score for each document; labels, lang, source and doc_id take no part."""
    small = None if weights is None else weights.astype(np.float32)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            out = []
            for text in batch.column(1):
                if small is None:
                    out.append(0.5)
                    continue
                at, x = features(text.as_py(), tokens)
                out.append(float(1 / (1 + np.exp(-np.clip(small[at] @ x, -35, 35)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def labelled(docs: DataFrame, labels: DataFrame, column: str, held_out: Column, bound: int | dict, seed: str) -> DataFrame:
    """doc_id, text and label of about `bound` learnable documents of each label, written.

    The sample is drawn among the labels, so that only its rows, of proven number, meet the texts, which stay where they are. One row
    stands for a doc_id, whether it repeats in labels (the larger label counts) or in documents (the smallest text does, before anything is shuffled).
    """
    one = labels.filter(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(column).cast("int").alias(column))
    met = docs.select("doc_id", "text").join(F.broadcast(sampled(one, column, bound, seed)), "doc_id")
    return materialize(met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max(column).alias(column)), f"sample-{column}")


def bounded(sample: DataFrame, size: Column, bound: int) -> DataFrame:
    """Rows of a written sample (order, ...), in their order as many as hold `bound` bytes; one that would exceed what is left is passed by.

    Two numbers a row of the sample come to the driver.
    """
    left, chosen = bound, []
    for order, n in sorted(map(tuple, sample.select("order", size.cast("long")).collect())):
        if n <= left:
            left -= n
            chosen.append(order)
    return sample.filter(F.col("order").isin(chosen))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 3) == 1
    weights = fit(labelled(docs, labels, "quality", held_out, SAMPLE_ROWS, "quality-classifier"), "quality")
    return score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
