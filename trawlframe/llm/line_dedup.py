"""Line de-duplication by a segment-partition edit join (DataFrame functions only).

Two lines are alike if they are equal, or at most `threshold` edits (code points changed, added or missing) apart. Lines are put in
classes of about the same length. Each line is indexed by threshold + 1 segments of its class, the first ones measured
from its start, the others from its end, and probes the index of its class, and of the class below if a line that short may be alike, with
the substrings that an alike line's segments can have moved to: if at most `threshold` edits part two lines, one segment is free of them and has no more
edits on either side than there are other segments. Lines that share a segment are split again by segments of what is left of them;
groups of up to HOT lines that agree on two segments or more list their pairs, without those that differ in too many letters or blocks; larger ones go on for up to
LEVELS levels. Every listed pair is verified by a banded bit-parallel edit distance, and what was verified is counted as links and joined to classes.

Every line with a word takes part; lines of fewer than MIN_CHARS characters only as equal ones, as an edit is much of a short line. Of a
class the occurrence with the smallest doc_id stays (then the first row, then the first line), all others go. Lines end at \\n; null
text has one empty line. Equal lines are known by their SHA-256 and enter the join once. Rows that share a doc_id are
separate rows. A null doc_id sorts after all others. An empty table has an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import table
from .common import WORD, likely, materialize, numbered, small
from .components import connected_components

THRESHOLD, MIN_CHARS = 2, 40
#: Pairs are listed in groups of up to HOT lines; larger groups are split, LEVELS times in all (a group of the last level is listed whatever its size).
HOT, LEVELS = 512, 6
#: In groups of more than FEW lines, blocks are compared before a pair is listed.
FEW, BLOCKS = 8, 16
#: Letters that are counted before a pair is listed.
LETTERS = "etaoinshrdlucmfw"


def lines_of(docs: DataFrame, uid: str) -> DataFrame:
    """uid, doc_id, pos and line of every line that has a word."""
    split = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line")
    return docs.select(F.col(uid).alias("uid"), "doc_id", split).filter(F.col("line").rlike(WORD))


def sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def class_of(n: Column, threshold: int) -> Column:
    """The smallest length of n's class: all but its four highest binary digits are zero, and at least so many of the lowest that a class is wider than the threshold."""
    low = F.greatest(F.length(F.bin(n)) - 4, F.lit(threshold.bit_length()))
    return F.call_function("shiftleft", F.call_function("shiftright", n, low), low)


def sized(rows: DataFrame, text: str, threshold: int) -> DataFrame:
    """Adds __n, the length of the text, __c, its class, and __b, the class of the shortest alike line: the same or the next one below."""
    n = rows.withColumn("__n", F.char_length(text))
    return n.withColumn("__c", class_of(F.col("__n"), threshold)).withColumn("__b", class_of(F.greatest(F.col("__n") - threshold, F.lit(0)), threshold))


def segments(text: str, threshold: int, make) -> list[Column]:
    """make(own, class, segment, at, width) for each segment of a `sized` row that is indexed (own = 1) or probed (0), null where there is none."""
    n, out = F.col("__n"), []
    for cls, own in (("__c", True), ("__b", False)):
        width = F.floor(F.col(cls) / (threshold + 1)).cast("int")
        for i in range(threshold + 1):
            reach = min(i, threshold - i)
            for shift in range(-reach, reach + 1):
                at = F.lit(i) * width + shift if i <= threshold - i else n - (threshold + 1 - i) * width + shift
                fits = (at >= 0) & (at + width <= n) if shift else F.lit(True)
                there = fits if own else fits & (F.col("__b") < F.col("__c"))
                out.append(F.when(there, make(int(own and not shift), F.col(cls), i, at, width)))
    return out


def meeting(keys: DataFrame) -> DataFrame:
    """key and n, the entries, of the keys (key, id, own) under which different ids meet, at least one of them as an index entry."""
    shared = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("own").alias("own"), F.count(F.lit(1)).alias("n"))
    return shared.filter("a <> b and own = 1").select("key", "n")


def occurrences(docs: DataFrame, uid: str, threshold: int) -> DataFrame:
    """One row per line occurrence, without its text: uid, doc_id, pos, sha, id (64 bits of it) and segment keys (the last bit marks an index entry)."""

    def key(own: int, cls: Column, i: int, at: Column, width: Column) -> Column:
        return F.shiftleft(F.xxhash64(cls, F.lit(i), F.substring(F.col("line"), at + 1, width)), 1).bitwiseOR(F.lit(own))

    rows = sized(lines_of(docs, uid), "line", threshold)
    keys = F.when(F.col("__n") >= MIN_CHARS, F.array(*segments("line", threshold, key)))
    found = rows.select("uid", "doc_id", "pos", sha(F.col("line")).alias("sha"), keys.alias("keys"))
    return found.withColumn("id", F.xxhash64("sha"))


def candidates(rows: DataFrame) -> DataFrame:
    """Ids of the lines that share a segment with another line."""
    keys = rows.filter("keys is not null").select("id", F.explode("keys").alias("k")).filter("k is not null")
    keys = keys.select("id", F.shiftrightunsigned("k", 1).alias("key"), F.col("k").bitwiseAND(F.lit(1)).alias("own"))
    shared = materialize(meeting(keys).select(F.col("key").alias("id")), "shared-segments")
    met = likely(keys.select(F.col("id").alias("line"), F.col("key").alias("id")), shared)
    return met.join(small(shared), "id").select(F.col("line").alias("id")).distinct()


def parted(rows: DataFrame, threshold: int) -> DataFrame:
    """(key, id, own, n, rest) of rows (key, id, rest) under each segment that another row of the same key shares; rest is without the segment."""

    def entry(own: int, cls: Column, i: int, at: Column, width: Column) -> Column:
        return F.struct(F.lit(own).alias("own"), F.xxhash64("key", cls, F.lit(i), F.substring(F.col("rest"), at + 1, width)).alias("key"), at.alias("at"), width.alias("width"))

    each = sized(rows, "rest", threshold).select(F.col("id").alias("line"), "rest", F.explode(F.array(*segments("rest", threshold, entry))).alias("e")).filter("e is not null")
    each = each.select("line", "rest", F.col("e.key").alias("id"), "e.own", "e.at", "e.width")
    shared = materialize(meeting(each.select(F.col("id").alias("key"), F.col("line").alias("id"), "own")).withColumnRenamed("key", "id"), "line-segments")
    rest = F.concat(F.substring("rest", F.lit(1), F.col("at")), F.substring(F.col("rest"), F.col("at") + F.col("width") + 1, F.length("rest")))
    return likely(each, shared.select("id")).join(small(shared), "id").select(F.col("id").alias("key"), F.col("line").alias("id"), "own", "n", rest.alias("rest"))


def blocks(text: str, threshold: int) -> list[Column]:
    """Of a `sized` text: hashes of BLOCKS blocks of its class, and for each block those of all substrings that it can have moved to in an alike text."""
    width = F.floor(F.col("__c") / BLOCKS).cast("int")

    def at(i: int, shift: int) -> Column:
        return F.hash(F.substring(F.col(text), F.greatest(F.lit(i) * width + shift, F.lit(0)) + 1, width))

    return [F.array(*[at(i, 0) for i in range(BLOCKS)]), F.array(*[F.array(*[at(i, shift) for shift in range(-threshold, threshold + 1)]) for i in range(BLOCKS)])]


def listed(members: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b, of the rows (key, id, own, n, rest) that share a key and may be alike.

    An edit changes two of the numbers of LETTERS in what is left by one at most, and in groups of more than FEW rows a pair has to agree on all but
    `threshold` blocks of it; that is looked at inside the join, so that no other pair leaves it.
    """
    held, moved = blocks("rest", threshold)
    many = F.col("n") > FEW
    bag = F.array(*[F.octet_length("rest") - F.octet_length(F.replace("rest", F.lit(c), F.lit(""))) for c in LETTERS]).alias("bag")
    sides = sized(members, "rest", threshold).select("key", "id", "own", "__n", "__c", bag, F.when(many, held).alias("held"), F.when(many, moved).alias("moved"))
    x, y = sides.alias("x"), sides.alias("y")
    lost = F.size(F.filter(F.zip_with("x.held", "y.moved", lambda h, m: F.array_contains(m, h)), lambda found: ~found))
    letters = reduce(Column.__add__, [F.abs(F.get("x.bag", F.lit(i)) - F.get("y.bag", F.lit(i))) for i in range(len(LETTERS))]) <= 2 * threshold
    near = F.col("x.held").isNull() | F.col("y.held").isNull() | (F.col("x.__c") != F.col("y.__c")) | (lost <= threshold)
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & ((F.col("x.own") == 1) | (F.col("y.own") == 1))
    return x.join(y, same & (F.abs(F.col("x.__n") - F.col("y.__n")) <= threshold) & letters & near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def pairs(lines: DataFrame, threshold: int, hot: int = HOT) -> DataFrame:
    """(a, b), a < b: every pair of different lines (id, line) that may be alike, listed segment by segment."""
    rows, found = lines.select(F.lit(0).cast("long").alias("key"), "id", F.col("line").alias("rest")), []
    for level in range(1, LEVELS + 1):
        groups = materialize(parted(rows, threshold), "line-groups")
        few = F.lit(level > 1) & (F.lit(level == LEVELS) | (F.col("n") <= hot))
        if level > 1:
            found.append(materialize(listed(groups.filter(few), threshold), "line-pairs"))
        rows = groups.filter(~few).select("key", "id", "rest").distinct()
        if level > 1 and rows.isEmpty():
            break
    return reduce(DataFrame.union, found).distinct()


def shared_length(x: Column, y: Column, part) -> Column:
    """The largest k at which part(x, k) equals part(y, k), where parts that agree agree for every smaller k."""
    powers = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    return let(F.least(F.length(x), F.length(y)), lambda most: F.aggregate(powers, F.lit(0), lambda k, step: F.when((k + step <= most) & (part(x, k + step) == part(y, k + step)), k + step).otherwise(k)))


def within(a: Column, b: Column, budget: int) -> Column:
    """Whether two strings are at most `budget` edits apart: a bit-parallel automaton on a diagonal band, run between what they share at both ends.

    After j characters of b, bit i of word e says that j - budget + i characters of a can be reached with e edits. A match
    and a changed character keep the bit, an added character moves it down, a missing one moves it up.
    """
    mask = (1 << (2 * budget + 1)) - 1

    def automaton(x: Column, y: Column) -> Column:
        def step(words: Column, j: Column) -> Column:
            c = F.get(y, j - 1)
            equal = reduce(Column.bitwiseOR, [F.when(F.get(x, j - budget + i - 1) == c, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(2 * budget + 1)])

            def moved(equal: Column) -> Column:
                new = [words[0].bitwiseAND(equal)]
                for e in range(1, budget + 1):
                    before = words[e - 1]
                    free = before.bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[-1], 1).bitwiseAND(F.lit(mask)))
                    new.append(words[e].bitwiseAND(equal).bitwiseOR(free))
                return F.array(*new)

            return let(equal, moved)

        start = F.array(*[F.lit(((1 << (e + 1)) - 1) << budget) for e in range(budget + 1)])
        end = F.aggregate(F.sequence(F.lit(1), F.size(y)), start, step)
        bits = F.array(*[F.lit(1 << i) for i in range(2 * budget + 1)])
        place = F.size(x) - F.size(y) + budget
        return F.exists(end, lambda w: w.bitwiseAND(F.get(bits, place)) != 0)

    def middle(x: Column, y: Column) -> Column:
        m, n = F.length(x), F.length(y)
        run = let(F.struct(F.split(x, "").alias("x"), F.split(y, "").alias("y")), lambda s: automaton(s["x"], s["y"]))
        return F.when(F.greatest(m, n) <= budget, F.lit(True)).when(F.abs(m - n) > budget, F.lit(False)).otherwise(run)

    def without(s: Column, k: Column, cut) -> Column:
        return F.struct(cut(s["x"], k).alias("x"), cut(s["y"], k).alias("y"))

    def tail(s: Column, k: Column) -> Column:
        return F.substring(s, k + 1, F.length(s))

    def head(s: Column, k: Column) -> Column:
        return F.substring(s, F.lit(1), F.length(s) - k)

    def ends(s: Column) -> Column:
        return let(without(s, shared_length(s["x"], s["y"], lambda t, k: F.substring(t, F.length(t) - k + 1, k)), head), lambda t: middle(t["x"], t["y"]))

    both = F.struct(a.alias("x"), b.alias("y"))
    return let(both, lambda s: let(without(s, shared_length(s["x"], s["y"], lambda t, k: F.substring(t, F.lit(1), k)), tail), ends))


def links(lines: DataFrame, threshold: int) -> DataFrame:
    """(a, b): SHA-256s of every two different lines (sha, line) that are alike, each verified, in one direction."""
    numbered_lines = materialize(lines.select("sha", "line", F.xxhash64("sha").alias("id")), "candidate-texts")
    of = lambda id_, sha_, line: numbered_lines.select(F.col("id").alias(id_), F.col("sha").alias(sha_), F.col("line").alias(line))
    near = materialize(pairs(numbered_lines.select("id", "line"), threshold), "near-lines")
    both = near.join(of("a", "sha_a", "x"), "a").join(of("b", "sha_b", "y"), "b")
    return both.filter(within(F.col("x"), F.col("y"), threshold)).select(F.col("sha_a").alias("a"), F.col("sha_b").alias("b"))


def line_classes(rows: DataFrame, docs: DataFrame, uid: str, threshold: int) -> DataFrame:
    """sha, first_doc, first_uid, first_pos and n_links of every line whose class occurs more than once."""
    wanted = materialize(candidates(rows), "candidate-lines")
    texts = lines_of(docs, uid).filter(F.char_length("line") >= MIN_CHARS).select(sha(F.col("line")).alias("sha"), "line").withColumn("id", F.xxhash64("sha"))
    lines = likely(texts, wanted).join(small(wanted), "id").groupBy("sha").agg(F.any_value("line").alias("line"))
    edges = materialize(links(lines, threshold), "line-links")
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    linked = edges.select(F.xxhash64("a").alias("id")).union(edges.select(F.xxhash64("b").alias("id")))
    told = materialize(again.union(linked).distinct(), "lines-with-others")
    rows = likely(rows, told).join(small(told), "id")  # all but lines that are alone
    counts = edges.select(F.col("a").alias("sha")).union(edges.select("b")).groupBy("sha").agg(F.count(F.lit(1)).alias("n_links"))
    roots = connected_components(edges).withColumnRenamed("node", "sha")
    first = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"), F.col("pos").alias("pos"))
    each = rows.groupBy("sha").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    named = each.join(roots, "sha", "left").filter("n > 1 or root is not null")
    named = materialize(named.join(counts, "sha", "left").select("sha", F.coalesce("root", "sha").alias("root"), "first", F.coalesce("n_links", F.lit(0)).alias("n_links")), "repeated-lines")
    kept = materialize(named.groupBy("root").agg(F.min("first").alias("f")), "line-classes")
    found = named.join(kept, "root").select("sha", "n_links", F.col("f.doc_id").alias("first_doc"), F.col("f.uid").alias("first_uid"), F.col("f.pos").alias("first_pos"))
    return materialize(found, "first-lines")


def repeated(docs: DataFrame, uid: str, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document that holds lines of such classes: uid, n_links, and dropped (pos, first_doc, first_pos) in order of pos."""
    rows = materialize(occurrences(docs, uid, threshold), "line-occurrences")
    firsts = line_classes(rows, docs, uid, threshold)
    goes = (F.col("uid") != F.col("first_uid")) | (F.col("pos") != F.col("first_pos"))
    ids = materialize(firsts.select(F.xxhash64("sha").alias("id")).distinct(), "first-ids")
    found = likely(rows.select("uid", "pos", "sha", "id"), ids).join(firsts, "sha")
    entry = F.when(goes, F.struct("pos", "first_doc", "first_pos"))  # collect_list leaves nulls out
    return found.groupBy("uid").agg(F.sum("n_links").alias("n_links"), F.array_sort(F.collect_list(entry)).alias("dropped"))  # as many as the text has lines


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """docs without repeated lines, with their own columns; a document that loses lines and has no word left goes. n_chars, if there, follows the text."""
    name = "__row_of_line_dedup"
    own = numbered(docs, name)
    cut = materialize(repeated(own, name, threshold).filter(F.size("dropped") > 0).select(F.col("uid").alias(name), F.col("dropped.pos").alias("__gone")), "dropped-lines")
    rest = let(F.split(F.col("text"), "\n", -1), lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone")), lambda i: F.get(parts, i)), "\n"))
    joined = own.join(small(cut, F.size("__gone") + 4), name, "left").withColumn("__rest", F.when(F.col("__gone").isNotNull(), rest))
    joined = joined.filter(F.col("__gone").isNull() | F.col("__rest").rlike(WORD)).withColumn("text", F.coalesce("__rest", "text"))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__gone").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)


def decide(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, n_links (links of its lines to different lines) and dropped (pos:first doc_id:first pos, by commas)."""
    name = "__row_of_lines"
    own = numbered(docs.select("doc_id", "text"), name)
    found = materialize(repeated(own, name, threshold), "line-decisions").withColumnRenamed("uid", name)
    text = F.coalesce("text", F.lit(""))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    told = F.array_join(F.transform("dropped", lambda d: F.concat_ws(":", d["pos"], F.coalesce(d["first_doc"].cast("string"), F.lit("")), d["first_pos"])), ",")
    joined = own.select(name, "doc_id", n_lines.cast("long").alias("n_lines")).join(found, name, "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("dropped").cast("long"), F.lit(0).cast("long")).alias("n_dropped"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce(told, F.lit("")).alias("dropped"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"))


def oracle(threshold: int = THRESHOLD) -> str:
    """DuckDB's levenshtein counts bytes, so a pair's characters beyond ASCII (up to 26 different ones) become control characters first."""
    width = f"(x.n // {threshold + 1})"
    parts = [f"contains(y.line, substring(x.line, {i} * {width} + 1, {width}))" for i in range(threshold + 1)]
    letters = "array_to_string(list_distinct(regexp_extract_all(x.line || y.line, '[^\\x00-\\x7F]')), '')"
    plain = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 32)])
    return f"""
WITH RECURSIVE split AS (SELECT doc_id, row_number() OVER () AS rn, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, rn, unnest(range(0, len(parts))) AS pos, unnest(parts) AS line FROM split),
part AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
d AS (SELECT line, length(line) AS n FROM part GROUP BY line),
e AS (SELECT x.line AS a, y.line AS b, {letters} AS f, {plain} AS t FROM d x, range(-{threshold}, {threshold} + 1) g(dn), d y
      WHERE y.n = x.n + dn AND x.line <> y.line AND x.n >= {MIN_CHARS} AND y.n >= {MIN_CHARS} AND ({' OR '.join(parts)})),
near AS (SELECT a, b FROM e WHERE levenshtein(translate(a, f, t), translate(b, f, t)) <= {threshold}),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, near.b FROM reach r JOIN near ON r.b = near.a),
class AS (SELECT d.line, least(d.line, coalesce(min(r.b), d.line)) AS root FROM d LEFT JOIN reach r ON r.a = d.line GROUP BY d.line),
degree AS (SELECT a AS line, count(*) AS k FROM near GROUP BY a),
held AS (SELECT p.*, root, coalesce(k, 0) AS k FROM part p JOIN class USING (line) LEFT JOIN degree USING (line)),
named AS (
  SELECT *, count(*) OVER (PARTITION BY root) AS total,
         first_value(doc_id) OVER w AS first_doc, first_value(rn) OVER w AS first_rn, first_value(pos) OVER w AS first_pos
  FROM held WINDOW w AS (PARTITION BY root ORDER BY doc_id NULLS LAST, rn, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
told AS (
  SELECT rn, CAST(sum(k) AS BIGINT) AS n_links, count(*) FILTER (rn <> first_rn OR pos <> first_pos) AS n_dropped,
         string_agg(pos || ':' || coalesce(CAST(first_doc AS VARCHAR), '') || ':' || first_pos, ',' ORDER BY pos) FILTER (rn <> first_rn OR pos <> first_pos) AS dropped
  FROM named WHERE total > 1 GROUP BY rn)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_links, 0) AS n_links, coalesce(dropped, '') AS dropped
FROM split LEFT JOIN told USING (rn)
"""


ORACLE = oracle()
