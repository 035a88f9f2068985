"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters, lower-cased (A-Z). The labelled tokens to learn from come from labelled documents: in
a toxic one, a word that toxic documents hold far more often than others is a toxic token, all
other tokens are clean. The field has two states; a token's score sums weights of its word, affixes and
letter groups and of the words beside it, so that unseen forms of a root are tagged too. Forward-backward gives
every token's marginal; a document's score is a logistic function of the largest and the summed ones.

Null and empty texts get the score of a document without tokens. Without both labels to learn from, scores are 0.5
and no span is found. Rows of documents that share a doc_id are scored one by one and count once in the sample, by the smallest text;
a doc_id that repeats among the labels counts once, by its larger label. A score of exactly 0.5 is predicted 1. An empty table has an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table
from .common import crc_mod
from .quality_classifier import bounded, labelled

#: Toxic and other rows to learn from, about; all, if there are fewer. Of their texts, so many bytes are learnt from at most.
SAMPLE_ROWS, SAMPLE_BYTES = {1: 800, 0: 1_600}, 8 << 20
DIM_BITS, ROUNDS, RATE, DECAY = 18, 40, 0.3, 1e-4
#: A toxic token's word is in so many different toxic texts at least, and so many times as often as in others.
LEAST_DOCS, LEAST_RATIO = 3, 40.0
#: Training cuts chains here; scoring never does.
TRAIN_CHAIN = 256
#: Tokens that are tagged at a time; a longer document is tagged alone.
BLOCK = 200_000

_TOKEN = re.compile(rb"[a-z\x80-\xff]+")


def tokens_of(text: str | None) -> list[bytes]:
    return _TOKEN.findall((text or "").encode().lower())


def word_features(word: bytes) -> list[int]:
    """Buckets of a word itself: the word, its first and last letters, all its groups of four letters in order."""
    own = [b"w" + word, *(b"p" + word[:k] for k in (3, 4, 5, 6) if len(word) > k), *(b"s" + word[-k:] for k in (3, 4) if len(word) > k)]
    own += dict.fromkeys(b"g" + word[i : i + 4] for i in range(len(word) - 3))
    return [(zlib.crc32(x) * 2654435761 & 0xFFFFFFFF) >> (32 - DIM_BITS) for x in own]


def word_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words one after the other, and how many each has."""
    buckets, many = array("i"), array("i")
    for w in words:
        own = word_features(w)
        buckets.extend(own)
        many.append(len(own))
    return np.frombuffer(buckets, np.int32), np.frombuffer(many, np.int32)


def beside_feature(word: bytes, side: bytes) -> int:
    return (zlib.crc32(side + word) * 2654435761 & 0xFFFFFFFF) >> (32 - DIM_BITS)


class Chains:
    """Chains of different lengths side by side: the longest first, so that those that still run are a prefix."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        self.starts = (np.cumsum(lengths) - lengths)[self.order]
        steps = int(self.lengths[0]) if len(lengths) else 0
        self.running = np.searchsorted(-self.lengths, -np.arange(steps), side="left")
        self.n = int(lengths.sum())

    def marginals(self, scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginal of state 1 per token, and forward and backward odds; scores are log-odds, trans[i, j] is the weight from i to j."""
        odds = np.exp(np.clip(scores, -30, 30))
        (a, b), (c, d) = np.exp(trans)
        ahead, behind = np.empty(self.n), np.ones(self.n)
        last = np.ones(len(self.starts))
        for step, k in enumerate(self.running.tolist()):
            at = self.starts[:k] + step
            r = last[:k]
            if step:
                r = (b + r * d) / (a + r * c)
            last[:k] = ahead[at] = np.clip(r * odds[at], 1e-30, 1e30)
        for step in range(len(self.running) - 1, 0, -1):
            k = self.running[step]
            at = self.starts[:k] + step
            r = np.clip(behind[at] * odds[at], 1e-30, 1e30)
            behind[at - 1] = (c + r * d) / (a + r * b)
        both = ahead * behind
        return both / (1 + both), ahead, behind

    def pairs(self, scores: np.ndarray, trans: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Expected number of each transition."""
        first = np.zeros(self.n, bool)
        first[self.starts[self.lengths > 0]] = True
        to = np.flatnonzero(~first)
        from_odds, right = ahead[to - 1], behind[to] * np.exp(np.clip(scores[to], -30, 30))
        e = np.exp(trans)
        joint = np.stack([np.full(len(to), e[0, 0]), e[0, 1] * right, e[1, 0] * from_odds, e[1, 1] * from_odds * right])
        return (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)


class Field:
    """Weights of the field, and what it says of words it has met (forgotten when too many)."""

    def __init__(self):
        self.unary = np.zeros(1 << DIM_BITS)
        self.left, self.right = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)
        self.bias, self.trans = 0.0, np.zeros((2, 2))
        self.last = np.zeros(3)  # logistic weights of a document: 1, largest log-odds, log of the summed marginals

    def score_words(self, words: list[bytes]) -> np.ndarray:
        """Three scores of each word: of itself, as left and as right neighbour."""
        buckets, many = word_buckets(words)
        own = np.add.reduceat(self.unary[buckets], np.cumsum(many) - many)  # every word has a bucket
        left = self.left[[beside_feature(w, b"<") for w in words]]
        return np.stack([own, left, self.right[[beside_feature(w, b">") for w in words]]], axis=1)

    def document_score(self, largest: np.ndarray, total: np.ndarray) -> np.ndarray:
        x = self.last[0] + self.last[1] * largest + self.last[2] * np.log(total + 1e-3)
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def with_neighbours(own: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray, bias: float) -> np.ndarray:
    """Log-odds of each token; first marks the tokens that open a document."""
    scores = own + bias
    inner = ~first
    inner_at = np.flatnonzero(inner)
    scores[inner_at] += left[inner_at - 1]
    scores[inner_at - 1] += right[inner_at]
    return scores


def sketch(ids: np.ndarray) -> set[tuple[int, int]]:
    """The smallest three-token groups under a few hashes: near copies of a text share one of them, as a rule, and others none."""
    x = ids.astype(np.uint64)
    groups = x[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ x[2:] * np.uint64(0x165667B19E3779F9) if len(x) > 2 else x
    return {(k, int((groups * np.uint64(2 * k + 0xD6E8FEB86659FD93)).min())) for k in range(4)} if len(x) else {(0, 0)}


def distinct_texts(ids: list[np.ndarray]) -> np.ndarray:
    """Which texts are no near copies of an earlier one."""
    seen: set[tuple[int, int]] = set()
    new = np.zeros(len(ids), bool)
    for i, own in enumerate(ids):
        marks = sketch(own)
        new[i] = not marks & seen
        seen |= marks
    return new


def weak_labels(ids: list[np.ndarray], toxic: np.ndarray, n_words: int) -> np.ndarray:
    """Which words mark toxic tokens, from the different texts that hold them."""
    held, n = np.zeros((2, n_words)), np.bincount(toxic, minlength=2)
    for own, y in zip(ids, toxic.tolist()):
        held[y, np.unique(own)] += 1
    return (held[1] >= LEAST_DOCS) & ((held[1] + 0.05) / max(n[1], 1) >= LEAST_RATIO * (held[0] + 0.5) / max(n[0], 1))


def train(texts: list[str], toxic: np.ndarray) -> Field:
    """Fit the field by gradient steps on the likelihood of the labelled tokens, then the logistic function of a document."""
    number: dict[bytes, int] = {}
    ids = []
    for text in texts:
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in tokens_of(text)), np.int32))
    new = distinct_texts(ids)
    ids, toxic = [x for x, keep in zip(ids, new) if keep], toxic[new]
    words = list(number)
    marked = weak_labels(ids, toxic, len(words))
    flat = np.concatenate([*ids, np.zeros(0, np.int32)])
    truth = marked[flat] & np.repeat(toxic == 1, [len(x) for x in ids])
    whole = np.array([len(x) for x in ids], np.int64)
    cut = np.concatenate([np.minimum(TRAIN_CHAIN, n - np.arange(0, n, TRAIN_CHAIN)) for n in whole.tolist()] + [np.zeros(0, np.int64)])
    chains = Chains(cut.astype(np.int64))
    first = np.zeros(len(flat), bool)
    first[(np.cumsum(cut) - cut)[cut > 0].astype(np.int64)] = True

    bucket, many = word_buckets(words)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), many)
    lefts = np.fromiter((beside_feature(w, b"<") for w in words), np.int32, len(words))
    rights = np.fromiter((beside_feature(w, b">") for w in words), np.int32, len(words))
    dim, field = 1 << DIM_BITS, Field()
    inner = np.flatnonzero(~first)
    true_pairs = np.bincount(truth[inner - 1] * 2 + truth[inner], minlength=4).reshape(2, 2)
    sums = [np.full(dim, 1e-8) for _ in range(3)]
    bias_sum, trans_sum = 1e-8, np.full((2, 2), 1e-8)
    weights = [field.unary, field.left, field.right]
    scale = 1 / max(truth.sum(), 1)

    def scored() -> np.ndarray:
        own = np.bincount(owner, weights=field.unary[bucket], minlength=len(words))
        return with_neighbours(own[flat], field.left[lefts][flat], field.right[rights][flat], first, field.bias)

    field.bias = float(np.log((truth.sum() + 1) / (len(truth) + 1 - truth.sum())))
    for _ in range(ROUNDS):
        scores = scored()
        p, ahead, behind = chains.marginals(scores, field.trans)
        residual = (truth - p) * scale
        by_word = np.bincount(flat, weights=residual, minlength=len(words))
        as_left = np.bincount(flat[inner - 1], weights=residual[inner], minlength=len(words))
        as_right = np.bincount(flat[inner], weights=residual[inner - 1], minlength=len(words))
        grads = [np.bincount(bucket, weights=by_word[owner], minlength=dim), np.bincount(lefts, weights=as_left, minlength=dim), np.bincount(rights, weights=as_right, minlength=dim)]
        for w, g, s in zip(weights, grads, sums):
            g = g - DECAY * w
            s += g * g
            w += RATE * g / np.sqrt(s)
        g = (true_pairs - chains.pairs(scores, field.trans, ahead, behind)) * scale
        trans_sum += g * g
        field.trans += RATE / 3 * g / np.sqrt(trans_sum)
        g = residual.sum()
        bias_sum += g * g
        field.bias += RATE / 3 * g / np.sqrt(bias_sum)
    p, _, _ = Chains(whole).marginals(scored(), field.trans)
    largest, total = per_document(p, whole)
    x = np.stack([np.ones(len(whole)), largest, np.log(total + 1e-3)], axis=1)
    for _ in range(100):  # Newton steps, with a small ridge
        q = 1 / (1 + np.exp(-np.clip(x @ field.last, -35, 35)))
        h = x.T @ (x * (q * (1 - q))[:, None]) + 0.5 * np.eye(3)
        field.last += np.linalg.solve(h, x.T @ (toxic - q) - 0.5 * field.last)
    return field


def per_document(p: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest log-odds (within 12) and summed marginals of each document; those of no tokens are -12 and 0."""
    largest, total = np.full(len(lengths), -12.0), np.zeros(len(lengths))
    some = np.flatnonzero(lengths)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        top = np.maximum.reduceat(p, starts)
        largest[some] = np.clip(np.log(top / np.maximum(1 - top, 1e-12) + 1e-12), -12, 12)
        total[some] = np.add.reduceat(p, starts)
    return largest, total


def fit(rows: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Field | None:
    """Learn from a written sample (doc_id, text, toxic); whole texts, of sample_bytes in all at most, go to the driver."""
    sample = rows.select(F.xxhash64("doc_id").alias("order"), F.col("toxic").cast("int").alias("toxic"), "text")
    found = bounded(sample, F.coalesce(F.octet_length("text"), F.lit(0)), sample_bytes).toPandas().sort_values(["order", "toxic"])
    toxic = found["toxic"].to_numpy(np.int64)
    return train(found["text"].tolist(), toxic) if len(set(toxic.tolist())) == 2 else None


class Tagger:
    """A field with a memory for words, for one Python worker."""

    def __init__(self, field: Field):
        self.field, self.number, self.table, self.used = field, {}, np.empty((1 << 16, 3)), 0

    def ids(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if new:
            scores = self.field.score_words(new)
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[self.used : self.used + len(new)] = scores
            self.number.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def forget(self) -> None:
        if self.used > 500_000:
            self.number, self.table, self.used = {}, np.empty((1 << 16, 3)), 0

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores of the documents, and the marginals of each one's tokens."""
        self.forget()
        ids = [self.ids(tokens_of(t)) for t in texts]
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids)
        first = np.zeros(len(flat), bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        own, left, right = self.table[flat].T
        p, _, _ = Chains(lengths).marginals(with_neighbours(own, left, right, first, self.field.bias), self.field.trans)
        return self.field.document_score(*per_document(p, lengths)), np.split(p, np.cumsum(lengths)[:-1])


def blocks(texts: list[str | None]) -> Iterator[list[int]]:
    """Positions of texts in groups of about BLOCK tokens (six characters each), the longest texts first.

    A group takes as many steps as its longest text has tokens, so texts of a length belong together.
    """
    group, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i] or "")):
        if group and size + len(texts[i] or "") > BLOCK * 6:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(texts[i] or "")
    if group:
        yield group


def offending(text: str, marginals: np.ndarray) -> list[tuple[int, int]]:
    """Code-point offsets of the tokens more likely toxic than not."""
    raw, out = text.encode().lower(), []
    for m, hit in zip(_TOKEN.finditer(raw), (marginals >= 0.5).tolist()):
        if hit:
            start = len(raw[: m.start()].decode())
            out.append((start, start + len(m[0].decode())))
    return out


def tag(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score and spans (start, end) of each document; labels, lang, source and doc_id take no part."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field) if field else None
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores, spans = [0.5] * len(texts), [[] for _ in texts]
            for group in blocks(texts) if tagger else ():
                found, marginals = tagger.tag([texts[i] for i in group])
                for i, s, p in zip(group, found.tolist(), marginals):
                    scores[i] = s
                    if len(p) and p.max() >= 0.5:
                        spans[i] = [{"start": a, "end": b} for a, b in offending(texts[i], p)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start: int, end: int>>")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 5) == 0
    field = fit(labelled(docs, labels, "toxic", held_out, SAMPLE_ROWS, "toxicity"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return tag(docs, field).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"), spans.alias("spans"))
