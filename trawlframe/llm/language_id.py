"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; one binary classifier per bit, over hashed character n-grams,
says on which side a text lies; the codeword with the smallest loss, weighted by how well each bit
does on each language, wins. A runner-up that is nearly as close makes the text ambiguous.

Null text and texts without a letter are 'und' with score 0. Ties go to the language that sorts first.
Without any row to learn from, every text is 'und'. Rows that share a doc_id are separate rows. An empty table has an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table
from .common import crc_mod, materialize, sampled, sliced

#: Rows of each language to learn from, about; all, if there are fewer.
SAMPLE_ROWS = 2_000
ORDERS, BUCKET_BITS = 3, 15
#: n-grams from which a text's evidence grows no further.
EVIDENCE = 30
#: Up to here every split of the languages is a bit; beyond, BITS_PER_DOUBLING random splits per doubling.
EXHAUSTIVE, BITS_PER_DOUBLING = 5, 10
#: A difference of losses below this is ambiguous.
AMBIGUOUS = 0.3
UND = "und"

_FOLD = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1, no two bits alike or complementary and none constant, far apart from each other."""
    if n < 2:
        return np.ones((n, 1))
    every = 1 << (n - 1)  # splits of the languages, by who is not with the last one; 0 is none
    if n <= EXHAUSTIVE:
        return _matrix(range(1, every), n)
    width, rng, best = int(np.ceil(BITS_PER_DOUBLING * np.log2(n))), random.Random(seed), (-1, None)
    for _ in range(200):
        splits: dict[int, None] = {}
        while len(splits) < width:
            splits[rng.randrange(1, every)] = None
        code = _matrix(splits, n)
        nearest = ((width - code @ code.T) / 2 + np.eye(n) * width).min()
        if nearest > best[0]:
            best = (nearest, code)
    return best[1]


def _matrix(splits: Iterable[int], n: int) -> np.ndarray:
    return np.array([[1.0 if split >> i & 1 else -1.0 for split in splits] for i in range(n)])


def ngrams(text: str) -> np.ndarray:
    """Buckets of all byte n-grams of the letters of a whole text, lower-cased, everything between them one space."""
    raw = np.frombuffer(f" {text.lower()} ".encode().translate(_FOLD), np.uint8)
    gap = raw == 0x20
    raw = raw[np.append(True, ~(gap[1:] & gap[:-1]))].astype(np.uint32)
    out, gram = [], np.zeros(len(raw), np.uint32)
    for order in range(1, ORDERS + 1):
        if len(raw) < order:
            break
        gram = gram[: len(raw) - order + 1] * np.uint32(257) + raw[order - 1 :]
        out.append((gram * np.uint32(2654435761) + np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        bits = []
        for bit in self.code.T:
            yes, no = share[bit > 0], share[bit < 0]
            bits.append(np.log(yes.mean(axis=0)) - np.log(no.mean(axis=0)) if len(yes) and len(no) else np.zeros(share.shape[1]))
        self.bits = np.array(bits, np.float32).T.copy()  # buckets x bits
        self.weights = np.full(self.code.shape, 1 / self.code.shape[1])

    def margins(self, text: str) -> np.ndarray:
        grams = ngrams(text)
        if len(grams) > 4_000:
            total = np.bincount(grams, minlength=len(self.bits)).astype(np.float32) @ self.bits
        else:
            total = self.bits[grams].sum(axis=0)
        return total / len(grams) * min(len(grams), EVIDENCE)

    def weigh(self, accuracy: np.ndarray) -> None:
        """accuracy: languages x bits; each language's weights sum to one."""
        self.weights = accuracy / accuracy.sum(axis=1, keepdims=True)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Language, score, ambiguous."""
        loss = (self.weights * np.logaddexp(0, -self.code * margins)).sum(axis=1)
        near = np.exp(-(loss - loss.min()) * self.code.shape[1])
        best = int(loss.argmin())
        rest = np.delete(loss, best)
        return self.languages[best], float(near[best] / near.sum()), bool(len(rest) and rest.min() - loss[best] < AMBIGUOUS)


def fit(rows: DataFrame) -> Model | None:
    """Learn from text and lang of rows; a bounded sample of each language, and two small tables for the driver.

    Those are one number per language and bucket, and one per language and bit.
    """
    known = rows.filter(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    sample = materialize(sampled(known, "lang", SAMPLE_ROWS, "language-id").select("lang", "text"), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                totals.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                totals[lang] += np.bincount(ngrams(text.as_py()), minlength=1 << BUCKET_BITS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])

    found = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    if not languages:
        return None
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    counts[found["lang"].map({x: i for i, x in enumerate(languages)}), found["bucket"]] = found["n"]
    model = Model(languages, counts)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hits = model.margins(text.as_py()) * model.code[languages.index(lang)] > 0
                out += [(lang, bit, bool(hit)) for bit, hit in enumerate(hits)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["lang", "bit", "hit"])

    accuracy = np.full(model.code.shape, 0.5)
    for lang, bit, rate in sample.mapInArrow(right, "lang string, bit long, hit boolean").groupBy("lang", "bit").agg(F.avg(F.col("hit").cast("int"))).collect():
        accuracy[languages.index(lang), bit] = max(rate, 1e-3)
    model.weigh(accuracy)
    return model


RESULT = ("lang_pred", "score", "ambiguous")


def identify(docs: DataFrame, model: Model | None, names: tuple[str, str, str] = RESULT) -> DataFrame:
    """The columns of docs, then language, score and whether it is ambiguous under the given names; lang, source and doc_id take no part.

    A column of docs that has one of these names (in any case) gives way.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in names} - {"text"}])
    own = docs.schema.names
    inner = [f"c{i}" for i in range(len(own))]  # names of docs may clash with ours
    judged = docs.toDF(*inner).withColumn("letter", F.coalesce(F.col(inner[own.index("text")]).rlike("\\p{L}"), F.lit(False)))
    at = own.index("text")
    types = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(inner, docs.schema.fields))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, letters = batch.column(at), batch.column(len(own)).to_pylist()
            out = [model.decode(model.margins(t.as_py())) if ok and model else (UND, 0.0, False) for t, ok in zip(texts, letters)]
            new = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *new], [*inner, *RESULT])

    found = judged.mapInArrow(score, f"{types}, lang_pred string, score double, ambiguous boolean")
    return found.toDF(*own, *names)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.filter(crc_mod("doc_id", 3) != 1)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(learnable(docs))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")
