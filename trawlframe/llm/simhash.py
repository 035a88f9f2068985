"""SimHash near-de-duplication by a binary trie self-join.

Fingerprints that differ in at most two bits agree on one of three blocks of bits, so equal blocks bring
together all that can link; inside such a group the fingerprints form a binary trie, and pairs of its nodes are
traversed together, with the bits that differ so far, until the error budget is exceeded. Copies share a
fingerprint and enter the join once. A group emits a spanning forest of its links, not all pairs, and
connected components over those forests give the classes.

That is op9's contract. The pipeline's stage (one_of_each) has a wider notion of near copies and joins longer fingerprints in the same way, see there.

Null text counts as empty; texts without a word have fingerprint zero and link like any other. Rows that
share a doc_id are separate rows; a null doc_id never names a class unless the class has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table
from .common import materialize, numbered, sliced, small
from .components import connected_components

BITS, BUDGET, WIDTH, SEED = 64, 2, 3, 42
#: Trie nodes with so few fingerprints are compared directly.
LEAF = 16


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hash of each run of `width` words, in order; of the whole text, if it has fewer; none without a word."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six blanks
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(lengths + 1) - lengths - 1
    last = max(n - width, 0)
    ends = (starts + lengths)[min(width, n) - 1 :]
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter((hash_of(line[a:b], SEED) for a, b in zip(starts[: last + 1].tolist(), ends.tolist())), np.uint64, last + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that most of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text."""
    return majority(shingles(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """uid, doc_id and fp, the fingerprint as a signed long; one row per document (uid, doc_id, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["uid", "doc_id", "fp"])

    return docs.mapInArrow(make, f"uid {docs.schema['uid'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


class Forest:
    """Union-find over positions of one group; link() says whether the link joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def joined(forest: Forest, near: np.ndarray, lo: int, low: int) -> list[tuple[int, int]]:
    """Links of the matrix `near` (rows from position lo, columns from low) that join trees, until its links join no more."""
    links = []
    while near.any():
        x, y = (np.array([forest.find(at + i) for i in range(n)]) for at, n in ((lo, near.shape[0]), (low, near.shape[1])))
        near = near & (x[:, None] != y[None, :])
        rows = np.flatnonzero(near.any(axis=1))
        links += [(lo + i, low + j) for i, j in zip(rows.tolist(), near[rows].argmax(axis=1).tolist()) if forest.link(lo + i, low + j)]
    return links


def trie_links(fps: np.ndarray, budget: int = BUDGET, leaf: int = LEAF, forest: Forest | None = None) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions, of the links among sorted distinct fingerprints (numbers, or rows of them, the highest first).

    A trie node is a range of the sorted array and a bit; the walk goes over pairs of nodes with the number
    of bits in which they differ already. A forest that is given says what is joined already.
    """
    words = fps.reshape(len(fps), -1)
    forest, links, top = forest or Forest(len(fps)), [], BITS * words.shape[1] - 1
    stack = [(0, len(fps), 0, len(fps), top, 0)]

    def halves(lo: int, hi: int, bit: int) -> tuple[tuple[int, int], tuple[int, int]]:
        one = np.uint64(1 << bit % BITS)
        middle = lo + int(np.searchsorted((words[lo:hi, (top - bit) // BITS] & one) != 0, True))
        return (lo, middle), (middle, hi)

    while stack:
        lo, hi, low, high, bit, errors = stack.pop()
        if lo == hi or low == high or errors > budget:
            continue
        if (hi - lo) * (high - low) <= leaf * leaf or bit < 0:
            near = sum(np.bitwise_count(w[lo:hi, None] ^ w[None, low:high]) for w in words.T) <= budget
            links += joined(forest, np.triu(near, 1) if lo == low else near, lo, low)
            continue
        zero, one = halves(lo, hi, bit)
        if lo == low:
            stack += [(*zero, *one, bit - 1, errors + 1), (*zero, *zero, bit - 1, errors), (*one, *one, bit - 1, errors)]
        else:
            other_zero, other_one = halves(low, high, bit)
            stack += [(*zero, *other_one, bit - 1, errors + 1), (*one, *other_zero, bit - 1, errors + 1), (*zero, *other_zero, bit - 1, errors), (*one, *other_one, bit - 1, errors)]
    return links


#: A group with more fingerprints than this is split by blocks of the bits that it does not agree on, of which again one must agree.
SPLIT = 20_000


def low_bits(n: Column) -> Column:
    """A number whose n lowest bits are set; n below 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1


def blocks(rest: Column, width: Column, budget: int) -> Column:
    """Of the `width` lowest bits of rest, each of budget + 1 blocks: value, rest without the block, and the width of that."""
    out = []
    for j in range(budget + 1):
        lo, hi = (F.floor(width * k / (budget + 1)).cast("int") for k in (j, j + 1))
        above = F.when(hi >= BITS, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", rest, F.least(hi, F.lit(BITS - 1))))
        value = F.call_function("shiftrightunsigned", rest, lo).bitwiseAND(low_bits(hi - lo))
        left = rest.bitwiseAND(low_bits(lo)).bitwiseOR(F.call_function("shiftleft", above, lo))
        out.append(F.struct(F.lit(j).alias("j"), value.alias("value"), left.alias("rest"), (width - (hi - lo)).alias("width")))
    return F.array(*out)


def block_keys(nodes: DataFrame, split: int = SPLIT) -> DataFrame:
    """fp and key: fingerprints within the budget share one key at least, and a key has `split` fingerprints at most.

    Groups that are larger are split by the bits that are left until they are small enough; distinct fingerprints that agree on all but
    w bits are 2^w at most, so that ends.
    """
    todo, done, first = nodes.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), F.lit(BITS).alias("width")), [], True
    while first or not todo.isEmpty():
        parts = todo.select("fp", "key", F.explode(blocks(F.col("rest"), F.col("width"), BUDGET)).alias("e"))
        keyed = parts.select("fp", F.xxhash64("key", "e.j", "e.value").alias("key"), "e.rest", "e.width")
        keyed = keyed if first else materialize(keyed, "block-keys")
        large = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("w")).filter((F.col("n") > split) & (F.col("w") > BUDGET)).select("key"), "large-blocks")
        if large.isEmpty():
            done.append(keyed.select("fp", "key"))
            break
        marked = materialize(keyed.join(large.withColumn("large", F.lit(True)), "key", "left"), "marked-blocks")
        done.append(marked.filter("large is null").select("fp", "key"))
        todo, first = marked.filter("large").select("fp", "key", "rest", "width"), False
    return reduce(DataFrame.union, done)


def links(nodes: DataFrame, split: int = SPLIT) -> DataFrame:
    """(a, b): links among distinct fingerprints that connect all that the full set of links connects."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, carry = ["a", "b"], None

        def of(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            sizes = np.diff(cuts)
            for lo, size in zip(cuts[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                fps = np.unique(rows[lo : lo + size, 1].copy().view(np.uint64))
                if pairs := trie_links(fps):
                    at = np.array(pairs)
                    found.append((fps[at[:, 0]], fps[at[:, 1]]))
            a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.uint64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)

        for batch in batches:
            rows = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in ("key", "fp")], axis=1)
            rows = rows if carry is None else np.concatenate([carry, rows])
            if not len(rows):
                continue
            new = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            cuts = np.concatenate([[0], new])
            carry = rows[cuts[-1] :]  # the last group may go on
            yield of(rows, cuts)
        if carry is not None:
            yield of(carry, np.array([0, len(carry)]))

    return block_keys(nodes, split).repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long")


def classes(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """uid, doc_id, fp, component_id and first_uid: one row per document, with the class it belongs to and the row that names it."""
    number = F.col(uid) if uid else F.monotonically_increasing_id()
    hashed = fingerprints(docs.select(number.cast("string").alias("uid"), "doc_id", "text"))
    rows = materialize(hashed, "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("uid").alias("uid"))).alias("first")
    nodes = materialize(rows.groupBy("fp").agg(best), "distinct-fingerprints")
    roots = materialize(connected_components(links(nodes.select("fp"))), "roots").withColumnRenamed("node", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "placed-fingerprints")
    named = materialize(placed.groupBy("root").agg(F.min("first").alias("first")), "named-components")
    mapping = materialize(placed.select("fp", "root").join(named, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.uid").alias("first_uid")), "fingerprint-classes")
    return rows.join(mapping, "fp").select("uid", "doc_id", "fp", "component_id", "first_uid")


#: Near copies for the pipeline share SIMILARITY of their different runs of NEAR_WIDTH words (Jaccard) or more.
NEAR_WIDTH, SIMILARITY = 5, 0.8
#: They meet in one of FINGERPRINTS SimHashes of WORDS times 64 bits, in each of whose words BLOCKS blocks of BLOCK_BITS bits are keys. At SIMILARITY a bit
#: differs with a probability of 0.15, so that a pair has no block in common with one of 25,000; a closer one more rarely. NEAR_BUDGET + 1 blocks, of
#: which one would surely agree, would have four bits each.
FINGERPRINTS, WORDS, BLOCKS, BLOCK_BITS = 12, 2, 4, 14
#: Bits of a whole fingerprint in which pairs that meet may differ: of 114 beside the block 17 are expected at SIMILARITY, with a deviation of 4, and 57 of unlike texts.
NEAR_BUDGET = 30
#: What the first fingerprints have joined is one class for the others, so that crowds of near copies are linked once.
FIRST = 3
#: Groups of so many are compared directly, many groups at once; in larger ones trie nodes of NEAR_LEAF fingerprints are.
FEW, NEAR_LEAF = 16, 256
#: Pairs that met and differ in more bits of one more SimHash are not compared; at SIMILARITY 10 bits are expected, with a deviation of 3.
NEAR_BITS = 26
#: Members of a cluster that one task compares at once; a larger cluster is compared by blocks.
CLUSTER_ROWS = 1_024
_STEPS = np.random.default_rng(SEED).integers(0, 1 << 63, FINGERPRINTS * WORDS, np.uint64)
#: Each run of a text of SHORT runs or fewer has SHARES votes of its own bits. With one vote each, ties and whole steps of so few make pairs at SIMILARITY differ in up to twice as many bits.
SHORT, SHARES = 40, 16
_SHARES = np.random.default_rng(SEED + 1).integers(0, 1 << 63, SHARES, np.uint64)


def near_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The FINGERPRINTS SimHashes of a sorted set of hashes, word by word; none without a hash. Where as many hashes have a bit as have not, the smaller half of them decides, an odd number."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    ones, tie = np.zeros(BITS * len(_STEPS), np.int64), None
    for i in range(0, len(hashes), 1 << 8):
        x = hashes[i : i + (1 << 8), None] + _STEPS  # each word has hashes of its own, mixed as by splitmix64
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        if tie is None:
            half = max(min(len(hashes) // 2, 1 << 7) - 1, 0) | 1
            tie = 2 * bits[:half].sum(axis=0, dtype=np.int64) > half
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return np.packbits(2 * ones + tie > len(hashes), bitorder="little").view(np.uint64)


def near_words(hashes: np.ndarray) -> np.ndarray:
    """The fingerprints of a sorted set of hashes by its length, of one kind or of both: any two sets of SIMILARITY have a kind in common."""
    kinds = [near_fingerprints(hashes)] if len(hashes) > SIMILARITY * SHORT else []
    if len(hashes) <= SHORT:
        kinds.append(near_fingerprints(np.sort((hashes[:, None] + _SHARES).ravel())))
    return np.concatenate(kinds)


def sketches(docs: DataFrame) -> DataFrame:
    """uid, doc_id, key (the same for equal sets of word runs) and words, the fingerprints; one row per document (uid, doc_id, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [np.unique(shingles(t.as_py(), NEAR_WIDTH)) for t in batch.column(2)]
            keys = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            words = pa.array([near_words(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys, words], ["uid", "doc_id", "key", "words"])

    return docs.mapInArrow(make, f"uid {docs.schema['uid'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, words array<long>")


#: Labels that a task joins to trees before it tells them and begins anew.
TREE_LABELS = 200_000


class Stars(Forest):
    """Union-find over labels of any numbers; drawn() gives the links of all to the smallest of their trees."""

    def __init__(self):
        self.up = {}

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            self.up.setdefault(i, i)
            self.up.setdefault(j, j)
            self.link(i, j)

    def drawn(self) -> pa.RecordBatch:
        pairs = np.array([(root, i) for i in self.up if (root := self.find(i)) != i], np.int64).reshape(-1, 2)
        self.up = {}
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def group_links(group: np.ndarray, label: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), labels that fingerprints within NEAR_BUDGET of each other link in rows that are sorted by group."""
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(cuts, len(group)))
    found = []
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= FEW), sizes))  # a trie of so few is one leaf
    for lag in range(1, FEW):
        x, y = at[:-lag], at[lag:]
        same = group[x] == group[y]
        if not same.any():
            break
        x, y = x[same], y[same]
        near = sum(np.bitwise_count(w[x] ^ w[y]) for w in fps.T) <= NEAR_BUDGET
        found.append((label[x[near]], label[y[near]]))
    for lo, size in zip(cuts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        order = lo + np.lexsort(fps[lo : lo + size].T[::-1])
        own, forest = label[order], Forest(size)
        _, at_first, back = np.unique(own, return_index=True, return_inverse=True)
        forest.up = at_first[back].tolist()
        if pairs := trie_links(fps[order], NEAR_BUDGET, NEAR_LEAF, forest):
            ends = np.array(pairs)
            found.append((own[ends[:, 0]], own[ends[:, 1]]))
    a, b = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    return a[a != b], b[a != b]


def dealt(rows: DataFrame, groups: list[str], member: Column, most: int) -> tuple[DataFrame, bool]:
    """rows with a column cell, and whether there are groups of more than `most`: such a group is dealt to blocks by member, and each two blocks are a cell.

    The number of cells in which a row is grows with the root of the group's size, and so do a cell's rows; any two rows of a group meet in one.
    """
    parts = F.ceil(F.sqrt(F.col("n") * 16 / most)).alias("parts")
    sizes = materialize(rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(*groups, parts), "large-groups")
    one = F.lit(0).cast("long")
    if sizes.isEmpty():
        return rows.withColumn("cell", one), False
    own = F.pmod(F.xxhash64(member), F.col("parts"))
    each = F.transform(F.sequence(one, F.col("parts") - 1), lambda other: F.least(own, other) * F.col("parts") + F.greatest(own, other))
    met = rows.join(small(sizes, 2), groups, "left")
    return met.select(*rows.columns, F.explode(F.when(F.col("parts").isNull(), F.array(one)).otherwise(each)).alias("cell")), True


def near_links(nodes: DataFrame, first: int, last: int, split: int = SPLIT) -> DataFrame:
    """(a, b): labels of nodes (label, words) that the fingerprints from first to last link, by tries inside equal blocks of bits. Words may hold the fingerprints of two kinds.

    A task tells what its groups connect, each label once and linked to the smallest: the members of a crowd meet in most blocks, and the crowd's smallest is the same in most.
    """
    word = F.floor(F.col("block") / BLOCKS).cast("int")
    value = F.call_function("shiftrightunsigned", F.get("words", word), (F.col("block") % BLOCKS) * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    per = BLOCKS * WORDS
    key = (F.col("block") % (per * FINGERPRINTS) * (1 << BLOCK_BITS) + value).cast("int").alias("key")
    begin = F.floor(F.col("block") / per).cast("int") * WORDS
    names = [f"w{i}" for i in range(WORDS)]
    kinds = F.sequence(F.lit(0), F.size("words") - 1, F.lit(FINGERPRINTS * WORDS))
    numbers = F.flatten(F.transform(kinds, lambda at: F.sequence(at * BLOCKS + first * per, at * BLOCKS + last * per - 1)))
    each = nodes.filter(F.size("words") > 0).select("label", "words", F.explode(numbers).alias("block"))
    keyed = each.select(key, "label", *[F.get("words", begin + i).alias(n) for i, n in enumerate(names)])
    cells, _ = dealt(keyed, ["key"], F.col(names[0]), split)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, stars = None, Stars()

        def join_groups(rows: np.ndarray) -> None:
            group = np.append(0, np.cumsum((rows[1:, :2] != rows[:-1, :2]).any(axis=1)))
            stars.add(*group_links(group, rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64)))

        for batch in batches:
            rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)
            rows = rows if carry is None else np.concatenate([carry, rows])
            if not len(rows):
                continue
            cut = int(np.flatnonzero((rows[:, :2] == rows[-1, :2]).all(axis=1))[0])
            carry = rows[cut:]  # the last group may go on
            if cut:
                join_groups(rows[:cut])
            if len(stars.up) > TREE_LABELS:
                yield stars.drawn()
        if carry is not None:
            join_groups(carry)
        yield stars.drawn()

    ordered = cells.select("key", "cell", "label", *names).repartition("key", "cell").sortWithinPartitions("key", "cell")
    return ordered.mapInArrow(join, "a long, b long")


def near_clusters(nodes: DataFrame, split: int = SPLIT) -> DataFrame:
    """(cluster, id) of the nodes (id, words) that have links to others."""
    found = materialize(near_links(nodes.select(F.col("id").alias("label"), "words"), 0, FIRST, split), "first-links")
    roots = materialize(connected_components(thinned(found)), "first-clusters")
    labels = nodes.join(small(roots.withColumnRenamed("node", "id"), 2), "id", "left").select(F.coalesce("root", "id").alias("label"), "words")
    more = materialize(near_links(labels, FIRST, FINGERPRINTS, split), "more-links")
    both = thinned(more).union(roots.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    return connected_components(both).select(F.col("root").alias("cluster"), F.col("node").alias("id"))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of SIMILARITY or more."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= SIMILARITY * (len(a) + len(b) - common) - 1e-9


def set_classes(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest position in the class of each set, where similar sets are of a class; pairs of one class already are not compared."""
    fps, label = np.array([majority(x) for x in sets], np.uint64), np.arange(len(sets))
    for i in range(1, len(sets)):
        bits = np.bitwise_count(fps[:i] ^ fps[i])
        near = np.flatnonzero(bits <= NEAR_BITS)
        near = near[np.argsort(bits[near], kind="stable")]
        while len(near):
            j = near[0]
            if similar(sets[i], sets[j]):
                x, y = sorted((label[i], label[j]))
                label[: i + 1][label[: i + 1] == y] = x
                near = near[label[near] != x]
            else:
                near = near[1:]
    return label


def thinned(edges: DataFrame) -> DataFrame:
    """(a, b): fewer edges that connect the same. Each b is linked to the smallest of its partners a, and these, as many as it has keys, to that one."""
    partners = edges.groupBy("b").agg(F.collect_set("a").alias("all"))
    least = F.array_min("all")
    return partners.select(least.alias("a"), F.explode(F.concat(F.array("b"), "all")).alias("b")).filter("a <> b").distinct()


def near_classes(members: DataFrame) -> DataFrame:
    """(key, root): the class of each member (cluster, key, text), from exact comparisons inside its cluster.

    A cluster of more than CLUSTER_ROWS members is dealt to blocks, every two of them are compared in a task of their own, and what the tasks have
    linked is joined to classes. Their number grows with the root of the members', and so do a task's rows and the copies of a member.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, keys, sets = None, [], []

        def told() -> pa.RecordBatch:
            roots = [keys[i] for i in set_classes(sets).tolist()]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(roots, pa.binary())], ["key", "root"])

        for batch in batches:
            for cluster, number, key, text in zip(*(batch.column(i) for i in range(4))):
                if (cluster.as_py(), number.as_py()) != cell:
                    if keys:
                        yield told()
                    cell, keys, sets = (cluster.as_py(), number.as_py()), [], []
                keys.append(key.as_py())
                sets.append(np.unique(shingles(text.as_py(), NEAR_WIDTH)))
        if keys:
            yield told()

    cells, large = dealt(members, ["cluster"], F.col("key"), CLUSTER_ROWS)
    ordered = cells.select("cluster", "cell", "key", "text").repartition("cluster", "cell").sortWithinPartitions("cluster", "cell", "key")
    found = ordered.mapInArrow(compare, "key binary, root binary")
    if not large:
        return found
    links = connected_components(thinned(materialize(found.filter("key <> root").select(F.col("root").alias("a"), F.col("key").alias("b")), "near-links")))
    return links.select(F.col("node").alias("key"), "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies (SIMILARITY) of a document with a smaller doc_id, with their own columns.

    SimHash fingerprints link candidates: tries are walked inside equal blocks, as in op9, with more and longer fingerprints, as the error budget of
    such pairs is fifteen times that of op9. Components of these links are clusters, and exact sets decide inside those.
    """
    number = "__row_of_simhash"
    own = numbered(docs, number)
    rows = materialize(sketches(own.select(F.col(number).alias("uid"), "doc_id", "text")), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("uid").alias("uid"))).alias("first")
    nodes = materialize(rows.groupBy("key").agg(first, F.any_value("words").alias("words")), "distinct-sets")
    clusters = materialize(near_clusters(nodes.select(F.xxhash64("key").alias("id"), "words")), "clusters")
    wanted = clusters.join(nodes.select("key", "first", F.xxhash64("key").alias("id")), "id").select("cluster", "key", F.col("first.uid").alias(number))
    wanted = materialize(wanted, "cluster-members")
    found = materialize(near_classes(own.select(number, "text").join(small(wanted), number).select("cluster", "key", "text")), "near-classes")
    kept = nodes.join(found, "key", "left").groupBy(F.coalesce("root", "key")).agg(F.min("first").alias("first"))
    kept = materialize(kept.select(F.col("first.uid").alias(number)), "kept-documents")
    gone = materialize(rows.select(F.col("uid").alias(number)).join(kept, number, "left_anti"), "dropped-documents")  # fewer than those that stay
    return own.join(small(gone), number, "left_anti").drop(number)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
