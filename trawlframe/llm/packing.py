"""Best-fit packing after Martello-Toth dominance reduction.

Only lengths matter to packing, and there are at most `capacity` of them: the instance is a histogram, which is
all that reaches the driver, however many documents there are. The reduction fixes sets of pieces
that dominate every other way to fill their sequence, the rest is packed best-fit decreasing, and both
say how many sequences of each pattern to build. The pieces of a length then take their places by rank.

Null text counts as empty and still has its end token. Rows that share a doc_id are packed separately. Pieces of a length take
its places in no promised order. An empty table has an empty result.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from .common import materialize, sliced

CAPACITY, END = 2048, 0
#: Rows that are ranked together, about: a length with more is split into parts, up to so many that one task can add them up.
RANK_ROWS, RANK_PARTS = 250, 20_000


class Encoder:
    """Ids of whole texts by a byte-level BPE file of `tokenizers`, without special tokens of its own.

    tiktoken runs the same vocabulary and merges about six times faster; it is used where a file of ranks that holds
    just the same vocabulary lies beside, and `tokenizers` otherwise and for texts that tiktoken refuses.
    """

    def __init__(self, path: str):
        self.path, self.fast, self.refused = path, None, 0
        try:
            import public_tokenizers
            import tiktoken

            with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(path) as f:
                spec = json.load(f)
        except (ImportError, OSError):
            return
        letters = _byte_letters()
        own = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if {k: v for k, v in own.items() if v not in special.values()} == ranks:
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return np.array(self.fast.encode(text, allowed_special="all"), np.uint32)
            except BaseException as e:  # its regular expression gives up on some very long runs, by a panic that is no Exception
                if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                    raise
                self.refused += 1
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def _byte_letters() -> dict[str, int]:
    """The public byte-level BPE convention: printable Latin-1 stands for itself, the other bytes for U+0100 onwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, row and ids (little-endian unsigned 32-bit) of every piece, END included.

    Only a document of more than `capacity` ids is cut; all its pieces but the first are full. row numbers the pieces, whatever their doc_id.
    """
    names = ["doc_id", "piece", "start", "length", "row", "ids"]
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer or tokenizer_path())
        row = TaskContext.get().partitionId() << 40  # the same if the task is run again
        for batch in sliced(batches):
            at, out = [], []
            for place, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                first = len(ids) % capacity or min(capacity, len(ids))
                starts = [0, *range(first, len(ids), capacity)]
                out += [(k, a, b - a, row + k, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
                at += [place] * len(starts)
                row += len(starts)
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {key_type}, piece int, start long, length long, row long, ids binary")


Pattern = tuple[tuple[int, ...], int]


def dominance_reduction(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns (lengths of one sequence, number of sequences) that are fixed for good, and what is left.

    For a length a, from the largest down, let room be capacity - a and b the largest other piece that fits.
    {a, b} dominates if b fills the room, or if no two others fit beside a. {a, b, c}, with c the largest that
    still fits, dominates if no three others fit beside a and no two pieces that are both longer than c do: every
    way to fill the room then maps onto b and c piece by piece. {a} dominates if nothing fits. Removing
    pieces never breaks these conditions, so each set is fixed as often as its pieces last.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    fixed: list[Pattern] = []

    def largest(limit: int) -> int:
        found = np.flatnonzero(left[1 : max(limit, 0) + 1])
        return int(found[-1]) + 1 if len(found) else 0

    def smallest_above(limit: int, k: int) -> list[int]:
        out: list[int] = []
        for length in np.flatnonzero(left[limit + 1 :])[:k] + limit + 1:
            out += [int(length)] * int(min(k - len(out), left[length]))
        return out[:k]

    def fix(*lengths: int) -> None:
        each = {x: lengths.count(x) for x in lengths}
        times = min(int(left[x]) // n for x, n in each.items())
        for x, n in each.items():
            left[x] -= times * n
        fixed.append((lengths, times))

    changed = True
    while changed:
        changed = False
        for a in np.flatnonzero(left)[::-1].tolist():
            while left[a]:
                left[a] -= 1  # look at the others
                room, pair = capacity - a, ()
                b = largest(room)
                two = smallest_above(0, 3)
                if not b:
                    pair = (a,)
                elif b == room or len(two) < 2 or two[0] + two[1] > room:
                    pair = (a, b)
                elif len(two) < 3 or sum(two) > room:
                    left[b] -= 1
                    c = largest(room - b)
                    left[b] += 1
                    longer = smallest_above(c, 2)
                    if c and (len(longer) < 2 or sum(longer) > room):
                        pair = (a, b, c)
                left[a] += 1
                if not pair:
                    break
                fix(*pair)
                changed = True
    return fixed, {int(x): int(left[x]) for x in np.flatnonzero(left)}


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing on a histogram: equal sequences are filled together.

    Each length splits one class of sequences at most in three, so there are never more patterns than three for each length.
    """
    open_by_room: dict[int, list[list]] = {}
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        for room in sorted(r for r in open_by_room if r >= length):
            if not todo:
                break
            keep = []
            for content, times in open_by_room.pop(room):
                fit = room // length
                full = min(times, todo // fit)
                some = min(fit, todo - full * fit) if full < times else 0
                todo -= full * fit + some
                for n, k in ((full, fit), (1, some)):
                    if n and k:
                        open_by_room.setdefault(room - k * length, []).append([content + (length,) * k, n])
                if times - full - bool(some):
                    keep.append([content, times - full - bool(some)])
            open_by_room.setdefault(room, []).extend(keep)
        fit = capacity // length
        for n, k in ((todo // fit, fit), (1, todo % fit)):
            if n and k:
                open_by_room.setdefault(capacity - k * length, []).append([(length,) * k, n])
    return [(content, n) for found in open_by_room.values() for content, n in found]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = dominance_reduction(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from_rank, to_rank, in_each, first_sequence, offset): which ranks of a length go where."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for content, times in patterns:
        offset = 0
        for length in sorted(set(content), reverse=True):
            n = content.count(length)
            at = used.get(length, 0)
            out.append((length, at, at + n * times, n, sequence, offset))
            used[length] = at + n * times
            offset += n * length
        sequence += times
    return out


def ranked(pieces_table: DataFrame, counts: dict[int, int]) -> DataFrame:
    """rank, from 0 within each length, in place of row, without bringing a length's pieces into one task.

    counts, the histogram, says how many parts a length needs; pieces are dealt to them by row, so that a repeated or null doc_id is no
    hot key; the parts' sizes are then summed up.
    """
    spark = pieces_table.sparkSession
    many = spark.createDataFrame([(x, min(-(-n // RANK_ROWS), RANK_PARTS)) for x, n in counts.items()], "length long, parts long")  # one row a length
    parted = pieces_table.join(F.broadcast(many), "length").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parted.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("row"))
    return parted.withColumn("within", within).join(sums, ["length", "part"]).withColumn("rank", F.col("before") + F.col("within") - 1).drop("row", "part", "within", "before")


def pack(pieces_table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces.

    The histogram (at most `capacity` rows) goes to the driver, the slots (a few for each length) come back in the plan.
    """
    spark = pieces_table.sparkSession
    counts = {r[0]: r[1] for r in pieces_table.groupBy("length").count().collect()}
    rows = slots(plan(counts, capacity))
    return placed_by(ranked(pieces_table, counts), spark, rows)


def placed_by(ranks: DataFrame, spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Look each rank up among the slots of its length; the slots are bounded by the capacity, not by the data."""
    schema = "slot_length long, from_rank long, to_rank long, in_each long, first_sequence long, base long"
    at = spark.createDataFrame(rows, schema)
    by_length = at.groupBy("slot_length").agg(F.array_sort(F.collect_list(F.struct("from_rank", "to_rank", "in_each", "first_sequence", "base"))).alias("slots"))
    slot = F.filter("slots", lambda s: (F.col("rank") >= s["from_rank"]) & (F.col("rank") < s["to_rank"]))[0]
    found = ranks.join(F.broadcast(by_length), F.col("length") == F.col("slot_length")).withColumn("s", slot)
    nth = F.col("rank") - F.col("s.from_rank")
    sequence = F.col("s.first_sequence") + F.expr("(rank - s.from_rank) div s.in_each")
    return found.withColumn("sequence_id", sequence).withColumn("offset", F.col("s.base") + nth % F.col("s.in_each") * F.col("length")).drop("slot_length", "slots", "s", "rank")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """Every piece with its place; with ids=False their checksum only is written and returned."""
    cut = pieces(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return pack(materialize(cut if ids else cut.drop("ids"), "pieces"), capacity)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    found = packed(table(spark, sf_dir, "documents"), ids=False)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
