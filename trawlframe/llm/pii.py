"""Personal data, and terms that reveal it, by information-theoretic sanitisation (DataFrame functions only).

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. A run of key characters with a digit and a letter is a secret, if its
own information (length times the entropy of its characters) is SECRET_BITS or more and a character's SECRET_ENTROPY. Each different value is a
protected entity. The words of the documents that hold an entity are held against it: with document frequencies over the whole corpus, the pointwise
mutual information of word and entity, as a share of the entity's information content, is what the word discloses. From
MAX_DISCLOSURE on, and if the two meet in documents of MIN_CONTEXTS different contexts, the word is a span of kind term wherever it
stands in a document that holds the entity: it is generalised, and from REMOVE_DISCLOSURE on removed. Near copies of a text are one context (by
sketches of their runs of RUN words, ALIKE of MINIMA or more alike); a single context is no evidence, as every rare word of it would disclose everything.

Offsets are code points, ends exclusive. Null text counts as empty. Rows that share a doc_id are separate rows (and
separate documents in the frequencies). An entity that every document holds has no information to disclose. A secret that overlaps a base span is
none, and neither is a term that overlaps a base span or a secret. An empty table has an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import table
from .common import likely, materialize, numbered
from .components import connected_components

KINDS = ("email", "ip", "card", "phone", "secret", "term")
SECRET, TERM_KIND = 4, 5
#: The contract's patterns, with possessive repeats and anchors at the beginning of a run: the same matches in linear time. Then that of secrets.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+",
}
#: What a text must contain for the pattern to be worth a try.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){13}", "phone": r"\+[0-9]", "secret": PATTERNS["secret"]}
#: Bits that a secret holds at least, in all and a character.
SECRET_BITS, SECRET_ENTROPY = 56.0, 3.0
#: A word that may disclose: letters and digits, two or more.
TERM = r"[\p{L}\p{N}]{2,}+"
MIN_CONTEXTS, MAX_DISCLOSURE, REMOVE_DISCLOSURE = 2, 0.5, 0.95
#: Near copies meet under one of MINIMA / BAND keys of BAND minima each and agree on ALIKE minima.
RUN, MINIMA, BAND, ALIKE = 3, 32, 4, 24


def information(value: Column) -> Column:
    """Bits a character: the entropy of the characters of a non-empty text."""
    n = F.length(value)
    share = F.transform(F.array_distinct(F.split(value, "")), lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        double = F.when(i % 2 == 0, d * 2).otherwise(d)
        return total + F.when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
    address = value.rlike(f"^{part}(?:\\.{part}){{3}}$")
    bits = information(value)
    secret = value.rlike("[A-Za-z]") & (bits >= SECRET_ENTROPY) & (bits * F.length(value) >= SECRET_BITS)
    card = F.when(n.between(14, 19), luhn(digits)).otherwise(F.lit(False))
    return F.when(kind == 1, address).when(kind == 2, card).when(kind == 3, n.between(10, 15)).when(kind == SECRET, secret).otherwise(F.lit(True))


def protected_spans(docs: DataFrame, uid: str) -> DataFrame:
    """uid, doc_id, kind (its place in KINDS), start, end and value of base spans and secrets."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for k, name in enumerate(KINDS[:TERM_KIND]):
        hit = F.instr(text, "@") > 0 if name == "email" else text.rlike(GUARDS[name])
        gaps = F.split(text, PATTERNS[name], -1)
        # gaps and matches take turns, from gap to gap: only the lengths of gaps are kept
        found.append(F.when(hit, F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(PATTERNS[name]), F.lit(0)).alias("values"), F.transform(gaps, F.length).alias("gaps"))))
    each = docs.select(F.col(uid).alias("uid"), "doc_id", F.explode(F.filter(F.array(*found), lambda s: s.isNotNull())).alias("f"))
    entry = F.transform("f.values", lambda v, i: F.struct(i.alias("i"), v.alias("value"), F.get("f.gaps", i).alias("n")))
    rows = each.select("uid", "doc_id", F.col("f.kind").alias("kind"), F.explode(entry).alias("m")).select("uid", "doc_id", "kind", "m.*")
    before = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("n") + F.coalesce(F.sum(F.col("n") + F.length("value")).over(before), F.lit(0))
    placed = rows.select("uid", "doc_id", "kind", start.cast("long").alias("start"), "value")
    return placed.withColumn("end", F.col("start") + F.length("value")).filter(valid(F.col("kind"), F.col("value")))


def words_of(text: str = "text") -> Column:
    """The different words of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)), F.lower))


def document_frequencies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df) over all whole documents for the written terms `wanted`; words are made distinct inside a document, mostly left out by a bitmap if they are others, and summed before the shuffle."""
    words = docs.select(F.explode(words_of()).alias("term")).withColumn("id", F.xxhash64("term"))
    counted = likely(words, wanted.select(F.xxhash64("term").alias("id"))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.join(wanted, "term")


def contexts(own: DataFrame) -> DataFrame:
    """(uid, context) of documents (uid, text): near copies share a context."""

    def sketch(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - RUN, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(RUN)]))
        return let(runs, lambda r: F.transform(F.sequence(F.lit(1), F.lit(MINIMA)), lambda k: F.array_min(F.transform(r, lambda h: F.xxhash64(h, k)))))

    words = F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower)
    rows = materialize(own.select("uid", F.xxhash64("uid").alias("id"), let(words, sketch).alias("sketch")), "context-sketches")
    bands = F.transform(F.sequence(F.lit(0), F.lit(MINIMA // BAND - 1)), lambda b: F.xxhash64(b, F.slice("sketch", b * BAND + 1, F.lit(BAND))))
    each = rows.select("id", "sketch", F.explode(bands).alias("band"))
    first = each.groupBy("band").agg(F.min(F.struct("id", "sketch")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", "first")
    agree = F.size(F.filter(F.zip_with("sketch", "first.sketch", lambda x, y: x == y), lambda same: same))
    edges = each.join(materialize(first, "context-bands"), "band").filter((F.col("id") != F.col("first.id")) & (agree >= ALIKE))
    roots = connected_components(edges.select(F.col("first.id").alias("a"), F.col("id").alias("b")).distinct())
    return rows.select("uid", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("uid", F.coalesce("root", "id").alias("context"))


def several(rows: DataFrame, *by: str, name: str, min_contexts: int) -> DataFrame:
    """by and the number of rows, as `name`, of the groups with enough different contexts."""
    if min_contexts <= 2:  # the smallest and largest tell whether there are two
        found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name), F.min("context").alias("c0"), F.max("context").alias("c1"))
        return found.filter(F.lit(min_contexts < 2) | (F.col("c0") != F.col("c1"))).drop("c0", "c1")
    each = rows.groupBy(*by, "context").count()
    return each.groupBy(*by).agg(F.sum("count").alias(name), F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_contexts).drop("k")


def disclosing(docs: DataFrame, uid: str, held: DataFrame, n_docs: int, max_disclosure: float = MAX_DISCLOSURE, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """(uid, term, disclosure) of the documents (uid, entity) that hold an entity and the terms that disclose it beyond the threshold, each once."""
    entities = held.groupBy("entity").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= min_contexts)
    held = materialize(held.join(entities, "entity"), "recurring-entities")
    those = materialize(held.select("uid").distinct(), "documents-with-entities")  # small, so that no text is shuffled
    own = docs.select(F.col(uid).alias("uid"), "text").join(those, "uid", "left_semi")
    words = own.select("uid", F.explode(words_of()).alias("term"))
    words = materialize(words.join(materialize(contexts(own), "contexts"), "uid"), "words-with-entities")
    pairs = materialize(several(held.join(words, "uid"), "entity", "held", "term", name="both", min_contexts=min_contexts), "entity-terms")
    wanted = materialize(pairs.select("term").distinct(), "terms-with-entities")
    known = pairs.join(document_frequencies(docs, wanted), "term")
    n = F.lit(float(n_docs))
    pmi = F.log2(F.col("both") * n / (F.col("held") * F.col("df")))
    known = known.withColumn("disclosure", F.try_divide(pmi, F.log2(n / F.col("held"))))
    hits = materialize(known.filter(F.col("disclosure") >= max_disclosure).select("entity", "term", "disclosure"), "disclosing-terms")
    return held.select("uid", "entity").join(hits, "entity").groupBy("uid", "term").agg(F.max("disclosure").alias("disclosure"))


def places(docs: DataFrame, uid: str, terms: DataFrame) -> DataFrame:
    """uid, start, end and disclosure of every occurrence of a document's terms (uid, term, disclosure) in it."""
    those = materialize(terms.select("uid").distinct(), "documents-with-terms")
    own = docs.select(F.col(uid).alias("uid"), "text").join(those, "uid", "left_semi")
    gaps = F.transform(F.split("text", TERM, -1), F.length)
    split = own.select("uid", F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("words"), gaps.alias("gaps"))
    entry = F.transform("words", lambda w, i: F.struct(i.alias("i"), F.get("gaps", i).alias("n"), F.length(w).alias("long"), F.lower(w).alias("term")))
    rows = split.select("uid", F.explode(entry).alias("m")).select("uid", "m.*")
    end = F.sum(F.col("n") + F.col("long")).over(Window.partitionBy("uid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.select("uid", "term", (end - F.col("long")).alias("start"), end.alias("end"))
    return placed.join(terms, ["uid", "term"]).select("uid", "start", "end", "disclosure")


def find(docs: DataFrame, uid: str) -> DataFrame:
    """All spans: uid, kind, start, end and whether the span is to be removed, each once, overlaps included."""
    own = materialize(protected_spans(docs, uid), "protected-spans")
    held = materialize(own.select("uid", F.concat_ws(":", "kind", F.lower("value")).alias("entity")).distinct(), "entities")
    terms = materialize(disclosing(docs, uid, held, docs.count()), "document-terms")
    term = places(docs, uid, terms).select("uid", F.lit(TERM_KIND).alias("kind"), "start", "end", (F.col("disclosure") >= REMOVE_DISCLOSURE).alias("gone"))
    return own.select("uid", "kind", "start", "end", F.lit(False).alias("gone")).union(term)


def by_document(docs: DataFrame, uid: str) -> DataFrame:
    """uid and spans, the sorted array of (start, kind, end, gone), of each document that has any; as many as its text holds."""
    found = find(docs, uid).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "gone"))).alias("all"))

    def clear(s: Column, of: Column) -> Column:
        return ~F.exists(of, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    found = found.withColumn("base", F.filter("all", lambda s: s["kind"] < SECRET))
    found = found.withColumn("sure", F.filter("all", lambda s: (s["kind"] < SECRET) | ((s["kind"] == SECRET) & clear(s, F.col("base")))))
    return found.select("uid", F.array_sort(F.concat("sure", F.filter("all", lambda s: (s["kind"] == TERM_KIND) & clear(s, F.col("sure"))))).alias("spans"))


def told(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def sanitized(docs: DataFrame) -> DataFrame:
    """docs with every span generalised or removed; spans that overlap are one, of the first one's kind.

    Base spans and secrets become their kind in brackets. A term becomes [NUMBER], [NAME] (with a capital) or [WORD]; one that discloses REMOVE_DISCLOSURE or more goes.
    """
    name = "__row_of_pii"
    own = numbered(docs, name)
    rows = by_document(own, name).select("uid", F.explode("spans").alias("s")).select("uid", "s.*")
    order = Window.partitionBy("uid").orderBy("start", "kind")
    opens = F.col("start") >= F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = rows.withColumn("opens", opens).withColumn("group", F.sum(F.col("opens").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("uid", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "kind", "gone")).alias("first"))
    entry = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("first.kind").alias("kind"), F.col("first.gone").alias("gone"))
    spans = merged.groupBy("uid").agg(F.array_sort(F.collect_list(entry)).alias("__spans")).withColumnRenamed("uid", name)
    text = F.col("text")

    def tag(s: Column) -> Column:
        word = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        general = F.when(word.rlike(r"^\p{N}+$"), "[NUMBER]").when(word.rlike(r"\p{Lu}"), "[NAME]").otherwise("[WORD]")
        kind = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]"))
        return F.when(s["gone"], "").when(s["kind"] == TERM_KIND, general).otherwise(kind)

    def piece(s: Column, i: Column) -> Column:
        before = F.coalesce(F.get("__spans", i - 1)["end"], F.lit(0))
        return F.concat(F.substring(text, before + 1, s["start"] - before), tag(s))

    tail = F.substring(text, F.element_at("__spans", -1)["end"] + 1, F.length(text))
    joined = own.join(spans, name, "left")
    new = F.when(F.col("__spans").isNotNull(), F.concat(F.array_join(F.transform("__spans", piece), ""), tail)).otherwise(text)
    return joined.withColumn("text", new).select(*docs.columns)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = numbered(table(spark, sf_dir, "documents").select("doc_id", "text"), "__row")
    found = by_document(docs, "__row").withColumnRenamed("uid", "__row")
    spans = F.coalesce("spans", F.array().cast("array<struct<start: bigint, kind: int, end: bigint, gone: boolean>>"))
    joined = docs.select("__row", "doc_id").join(found, "__row", "left").select("doc_id", spans.alias("s"))

    def number(name: str, of) -> Column:
        return F.size(F.filter("s", of)).cast("long").alias(name)

    def of_kind(k: int):
        return lambda x: x["kind"] == k

    counts = [number(f"n_{kind}", of_kind(k)) for k, kind in enumerate(KINDS)]
    base = F.filter("s", lambda x: x["kind"] < SECRET)
    more = [*counts[SECRET:], number("n_removed", lambda x: x["gone"]), F.size("s").cast("long").alias("n_spans")]
    return joined.select("doc_id", *counts[:SECRET], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("s")).alias("spans"), *more)
