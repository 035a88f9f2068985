"""Quality rules by distribution divergence.

Two histograms of each text - character classes, and the common words of its language with everything else
as one more bin - are held against the references of its language by Jensen-Shannon distance. A word is common if it holds COMMON_SHARE of
its language's words, every document weighing the same; the reference is the mean over the language's documents that pass the base rule,
and there is one from LEAST_DOCS such documents on. A text with too few bytes or words is not judged by the histogram that needs them.

Null text has no words and fails the base rule. A text of null language, or of one without a reference, is held
against every reference, and the nearest counts; without any reference the base rule alone decides. Rows that share a doc_id are separate rows and
separate documents in the references. A distance equal to its limit passes. An empty table has an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table
from .common import materialize

#: Share of a language's words from which a word is common and has a bin of its own; documents that make a reference.
COMMON_SHARE, LEAST_DOCS = 0.002, 50
#: Different words that a task holds; beyond, it starts anew, which changes nothing in the result.
HELD_WORDS = 2_000_000
#: What a document weighs in its language's reference.
ONE = 1 << 26
#: Largest Jensen-Shannon distances (base 2, so 0 to 1) at which a text is kept.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.45
#: Below so many bytes or words a histogram says too little to reject by it.
MIN_BYTES, MIN_WORDS = 200, 50
SYMBOLS = b"#*$%&|<>"

#: Class of each UTF-8 byte: lower, upper, digit, space, line end, sentence mark, symbol, other mark, control, lead byte, further byte.
N_CLASSES = 11


def _class_of(b: int) -> int:
    c = chr(b)
    if b >= 0x80:
        return 9 if b >= 0xC0 else 10
    if c.islower():
        return 0
    if c.isupper():
        return 1
    if c.isdigit():
        return 2
    if c in " \t":
        return 3
    if c in "\n\r\x0b\x0c":
        return 4
    if c in ".,;:!?'\"-()":
        return 5
    if b in SYMBOLS:
        return 6
    return 7 if c.isprintable() else 8


CLASS_OF = np.array([_class_of(b) for b in range(256)], dtype=np.uint8)
_CLASS_TABLE = CLASS_OF.tobytes()


def char_histogram(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw.translate(_CLASS_TABLE), np.uint8), minlength=N_CLASSES)


def js_distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances, base 2, of each row of p to q, histograms of any sums; 0 if either is empty."""
    sums = p.sum(axis=1, keepdims=True)
    if not len(q) or not q.sum():
        return np.zeros(len(p))
    p, q = p / np.maximum(sums, 1e-300), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = (np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)) / 2
    return np.where(sums[:, 0] > 0, np.sqrt(np.maximum(d, 0.0)), 0.0)


#: Stands for all words of a language; no word holds a space.
_ALL = b" all"


def frequent_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n): words (A-Z lower-cased) with half of COMMON_SHARE or more of the words of a language in some part of the corpus, and what they weigh there.

    Every document has the same weight, ONE, shared out among its words in whole numbers, so that a very long one does not speak for its language and
    sums do not depend on their order. The parts are what a task has read. A word of COMMON_SHARE in all has half of that or more in some part, and
    its weights in such parts are half of that of the whole at least: so few words can be that, and only they leave the task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, own in words.items():
                least = own[_ALL] * COMMON_SHARE / 2
                heavy = {w: n for w, n in own.items() if n >= least}
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(heavy)), pa.array([w.decode() for w in heavy]), pa.array(heavy.values(), pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = (text.as_py() or "").encode().lower().split()
                if found:
                    own, share = words.setdefault(lang, Counter()), ONE // len(found)
                    for word, k in Counter(found).items():
                        own[word] += k * share
                    own[_ALL] += share * len(found)
            if sum(map(len, words.values())) > HELD_WORDS:
                yield from told()
                words.clear()
        yield from told()

    known = docs.filter(F.col("lang").isNotNull()).select("lang", "text")
    return known.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame) -> list[bytes]:
    """Every word that may be common in a language, sorted; at most 2 / COMMON_SHARE a language come to the driver."""
    counts = materialize(frequent_words(docs), "frequent-words")
    totals = {r[0]: r[1] for r in counts.filter(F.col("word") == _ALL.decode()).select("lang", "n").collect()}
    if not totals:
        return []
    least = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, n * COMMON_SHARE / 2)])
    heavy = counts.filter((F.col("word") != _ALL.decode()) & (F.col("n") >= least[F.col("lang")])).select("word").distinct()
    return sorted(r[0].encode() for r in heavy.collect())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six blanks
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r")))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, dup = set(), 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.split(None, 1):
                seen.add(line)
    repeat = 0
    if n > 3:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids, size = np.fromiter(map(number.__getitem__, words), np.int64, n), len(number)
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]  # so that no product overflows
        _, group, times = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
        again = times[group] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeat = int(covered.sum())
    return n, word_chars, symbols, dup, repeat


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """One row per document: doc_id, lang, the base counts and verdict, bytes, character classes, and which of `words` (by number) it holds how often."""
    number = {w: i for i, w in enumerate(words)}
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(2):
                text = value.as_py() or ""
                raw = text.encode()
                counts = base_counts(text)
                n, repeat = counts[0], counts[4]
                held = {number[w]: k for w, k in Counter(raw.lower().split()).items() if w in number}
                at = np.array(sorted(held), "<u4")
                times = np.array([held[i] for i in at.tolist()], "<u4")
                out.append((*counts, n < 50 or 100 * repeat > 50 * n, len(raw), char_histogram(raw).astype("<u4").tobytes(), at.tobytes(), times.tobytes()))
            if out:
                kinds = [*[pa.int64()] * 5, pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "lang", *COUNTS, "base_failed", "n_bytes", "classes", "at", "times"])

    schema = f"doc_id {key_type}, lang string, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, n_bytes long, classes binary, at binary, times binary"
    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(measure, schema)


class Reference:
    """One language: class weights, the numbers of its common words, and their weights with all others last."""

    def __init__(self, classes: np.ndarray, at: np.ndarray, weights: np.ndarray):
        self.classes, self.at, self.weights = classes, at, weights


def references(found: DataFrame, n_words: int) -> dict[str, Reference]:
    """A reference per language from the table of `measured`; one number per language and word comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, failed, n, size, classes, at, times in zip(*(c.to_pylist() for c in batch.columns)):
                if not size:
                    continue
                # all words, then those of documents that pass, each with the sum last; classes; documents that pass
                own = sums.setdefault(lang, np.zeros(2 * (n_words + 1) + N_CLASSES + 1, np.int64))
                share, places = ONE // max(n, 1), np.frombuffer(at, "<u4").astype(np.int64)
                weight = np.frombuffer(times, "<u4").astype(np.int64) * share
                own[places] += weight
                own[n_words] += share * n
                if not failed:
                    own[n_words + 1 + places] += weight
                    own[2 * n_words + 1] += share * n
                    own[2 * n_words + 2 : -1] += np.frombuffer(classes, "<u4").astype(np.int64) * ONE // size
                    own[-1] += 1
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(own[at])], ["lang", "place", "n"])

    known = found.filter("lang is not null").select("lang", "base_failed", "n_words", "n_bytes", "classes", "at", "times")
    sums: dict[str, np.ndarray] = {}
    for lang, place, n in known.mapInArrow(add, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).collect():
        sums.setdefault(lang, np.zeros(2 * (n_words + 1) + N_CLASSES + 1))[place] = n
    out = {}
    for lang, own in sorted(sums.items()):
        every, passing = own[: n_words + 1], own[n_words + 1 : 2 * n_words + 2]
        if own[-1] >= LEAST_DOCS:
            at = np.flatnonzero((every[:-1] >= COMMON_SHARE * every[-1]) & (every[:-1] > 0))
            out[lang] = Reference(own[2 * n_words + 2 : -1], at, np.append(passing[at], passing[-1] - passing[at].sum()))
    return out


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts and verdict, whether it is kept, and both distances to the nearest reference in question."""
    words = vocabulary(docs)
    found = materialize(measured(docs, words), "text-measures")
    known = references(found, len(words))
    names = ["doc_id", *COUNTS, "base_failed", "kept", "char_distance", "word_distance"]

    def distances(model: Reference, rows: list[tuple]) -> np.ndarray:
        place = np.full(len(words) + 1, -1)
        place[model.at] = np.arange(len(model.at))
        bins = np.zeros((len(rows), len(model.at) + 1))
        for own, (_, n, _, at, times) in zip(bins, rows):
            to = place[np.frombuffer(at, "<u4").astype(np.int64)]
            own[to[to >= 0]] = np.frombuffer(times, "<u4")[to >= 0]
            own[-1] = n - own[:-1].sum()
        classes = np.array([np.frombuffer(r[2], "<u4") for r in rows], float)
        return np.stack([js_distances(classes, model.classes), js_distances(bins, model.weights)], axis=1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                of = dict(zip(batch.schema.names, batch.columns))
                rows = list(zip(*(of[c].to_pylist() for c in ("lang", "n_words", "classes", "at", "times"))))
                nearest = np.zeros((len(rows), 2))
                groups: dict[str | None, list[int]] = {}
                for i, r in enumerate(rows):
                    groups.setdefault(r[0] if r[0] in known else None, []).append(i)
                for lang, places in groups.items():
                    among = [known[lang]] if lang is not None else list(known.values())
                    each = [distances(m, [rows[i] for i in places]) for m in among]
                    if each:
                        best = np.argmin([d.max(axis=1) for d in each], axis=0)
                        nearest[places] = np.array(each)[best, np.arange(len(places))]
                size, n, failed = (np.asarray(of[c].to_numpy(zero_copy_only=False)) for c in ("n_bytes", "n_words", "base_failed"))
                bad = ((size >= MIN_BYTES) & (nearest[:, 0] > MAX_CHAR_DISTANCE)) | ((n >= MIN_WORDS) & (nearest[:, 1] > MAX_WORD_DISTANCE))
                yield pa.RecordBatch.from_arrays([*(of[c] for c in names[:7]), pa.array(~failed.astype(bool) & ~bad), pa.array(nearest[:, 0]), pa.array(nearest[:, 1])], names)

    key_type = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {key_type}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, char_distance double, word_distance double"
    return found.mapInArrow(score, result)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
