"""From pages to the resources that their markup refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, urls
from ..functions.binding import let


def marked(pages: DataFrame, tags: tuple[str, ...] = html.URL_TAGS, match=html.resource_url) -> DataFrame:
    """page_id, url and found: per page the array of (tag, attrs, source_url) in document order.

    `match(tag, attrs)` gives a tag's URL or null to pass it by. All inside one projection: no shuffle, no Python.
    """
    opened = F.filter(F.transform(html.tokens(F.col("html")), lambda t: F.struct(html.tag_name(t).alias("tag"), t.alias("token"))), lambda s: s["tag"].isin(*tags))
    read = F.transform(opened, lambda s: F.struct(s["tag"].alias("tag"), html.attributes(s["token"]).alias("attrs")))
    with_url = F.transform(read, lambda s: F.struct(s["tag"].alias("tag"), s["attrs"].alias("attrs"), match(s["tag"], s["attrs"]).alias("source_url")))
    return pages.select("page_id", "url", F.filter(with_url, lambda s: s["source_url"].isNotNull()).alias("found"))


def resources(pages: DataFrame) -> DataFrame:
    """page_id, url, pos (from 0 in a page's document order), tag, attrs, source_url."""
    return marked(pages).select("page_id", "url", F.posexplode("found").alias("pos", "r")).select("page_id", "url", F.col("pos").cast("long").alias("pos"), "r.tag", "r.attrs", "r.source_url")


def attribute_map(attrs: Column) -> Column:
    """Attributes as a map; of a name that repeats, the first one holds."""
    pairs = F.transform(attrs, lambda a: F.struct(html.attribute_name(a).alias("k"), html.attribute_value(a).alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def resolved(found: DataFrame) -> DataFrame:
    """Adds base and ref (URL structs), abs (the absolute struct), target (its text), kept and kind to resources.

    A reference's fragment goes before it is resolved. Kept are valid references whose host, port included, is the page's own;
    anchors are pages, all else assets. A row that is not kept has its reason in `dropped`.
    """
    bare = urls.without_fragment(F.col("source_url"))
    taken = found.withColumn("base", urls.parts(F.col("url"))).withColumn("ref", urls.parts(bare))
    ok = urls.valid(F.col("source_url"), urls.parts(F.col("source_url")))
    taken = taken.withColumn("ok", ok).withColumn("abs", urls.resolve(F.col("base"), F.col("ref")))
    same = F.col("abs.host") == F.col("base.host")
    dropped = F.when(~F.col("ok"), "invalid").when(~same, "external")
    return taken.withColumn("dropped", dropped).withColumn("kept", F.col("dropped").isNull()).withColumn("target", urls.text(F.col("abs"))).withColumn("kind", F.when(F.col("tag") == "a", "page").otherwise("asset")).drop("ok")


def target_of(base: Column, source: Column) -> Column:
    """The struct of a reference (its text as it stands) seen from a page (the struct of its URL), null where resolved() would drop it."""

    def of(f: Column) -> Column:
        absolute = let(urls.resolve(base, urls.parts(f["bare"])), lambda a: F.when(a["host"] == base["host"], a))
        return F.when(urls.valid(f["source"], f["whole"]), absolute)

    return let(F.struct(source.alias("source"), urls.without_fragment(source).alias("bare"), urls.parts(source).alias("whole")), of)


def references(pages: DataFrame) -> DataFrame:
    """The kept references of pages."""
    return resolved(resources(pages)).filter("kept")


def links(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, link_url; only anchors are looked at, repeated links stay."""
    anchors = marked(pages, ("a",)).select("page_id", "url", F.posexplode("found").alias("pos", "r")).select("page_id", "url", F.col("pos").cast("long").alias("pos"), "r.tag", "r.source_url")
    return resolved(anchors).filter("kept").select("page_id", "url", "pos", F.col("target").alias("link_url"), "abs")


def assets(pages: DataFrame) -> DataFrame:
    """page_id, pos, tag, asset_kind, asset_url; pages without any such tag are passed by before their markup is read."""
    likely = pages.filter(F.col("html").rlike("(?i)<(?:link|script|img)[\\t\\n\\f\\r />]"))
    found = references(likely).filter("kind = 'asset'")
    kind = F.when(F.col("tag") == "link", "css").when(F.col("tag") == "script", "script").otherwise("image")
    return found.select("page_id", "url", "pos", "tag", kind.alias("asset_kind"), F.col("target").alias("asset_url"), "abs")


def children(pages: DataFrame) -> DataFrame:
    """Edges src_url, kind, kind_rank, pos, dst_url: a page's links before its assets, each in document order."""
    found = references(pages)
    return found.select(F.col("url").alias("src_url"), "kind", F.when(F.col("kind") == "page", 0).otherwise(1).alias("kind_rank"), "pos", F.col("target").alias("dst_url"))


def occurrences(found: DataFrame) -> DataFrame:
    """asset_url, page_id and k, how often the page refers to the asset: one row per pair, however many pages an asset has."""
    return found.groupBy("asset_url", "page_id").agg(F.count(F.lit(1)).alias("k"))


def occurrences_by_url(found: DataFrame) -> DataFrame:
    """asset_url, n and page_ids (ascending, joined by commas) in one row per asset: the text form of occurrences(), for assets of a bounded number of pages."""
    ids = F.array_sort(F.collect_list(F.struct("page_id", "k")))
    joined = F.array_join(F.flatten(F.transform(ids, lambda s: F.array_repeat(s["page_id"].cast("string"), s["k"].cast("int")))), ",")
    return occurrences(found).groupBy("asset_url").agg(F.sum("k").alias("n"), joined.alias("page_ids"))
