"""Save paths, relative links and rewritten documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, paths, urls
from ..functions.binding import let
from ..storage import numbered
from .extract import references, target_of


def page_path(p: Column) -> Column:
    """Where a page is saved: 'index' at a root, '.html' always added."""
    return let(p, lambda q: paths.save_path(urls.decoded_path(q), urls.text(q), "index", "html"))


def link_path(p: Column, root_name: str = "") -> Column:
    """Where a rewritten link points: MD5 of the URL at a root, unless a root_name (such as 'index') mends that."""
    return let(p, lambda q: paths.save_path(urls.decoded_path(q), urls.text(q), root_name, "html"))


def asset_path(p: Column) -> Column:
    return let(p, lambda q: paths.save_path(urls.decoded_path(q), urls.text(q), "", ""))


def with_page_path(pages: DataFrame) -> DataFrame:
    return pages.withColumn("save_path", page_path(urls.parts(F.col("url"))))


def last_writers(items: DataFrame, order: str) -> DataFrame:
    """Of items that share a host and save_path, the last one by `order` (then the last row) stays: what is left on disk after all are saved.

    The winners are found by their keys; other columns, content among them, take no part in that.
    """
    name = "__row_of_items"
    own = numbered(items, name)
    last = own.groupBy("host", "save_path").agg(F.max(F.struct(F.col(order).alias("order"), F.col(name).alias("row"))).alias("last"))
    return own.join(last.select(F.col("last.row").alias(name)), name, "left_semi").drop(name)


def collisions(pages: DataFrame) -> DataFrame:
    """host, save_path and n of each path that several pages of a host are saved at."""
    placed = with_page_path(pages).withColumn("host", urls.parts(F.col("url"))["host"])
    return placed.groupBy("host", "save_path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def rewrite_map(pages: DataFrame, root_name: str = "") -> DataFrame:
    """page_id, pos, tag, old_url (as it stands), target, new_url of every kept reference."""
    found = references(pages).withColumn("page_path", page_path(F.col("base")))
    to = F.when(F.col("tag") == "a", link_path(F.col("abs"), root_name)).otherwise(asset_path(F.col("abs")))
    return found.withColumn("to", to).select("page_id", "pos", "tag", F.col("source_url").alias("old_url"), "target", paths.relative_url(F.col("page_path"), F.col("to")).alias("new_url"))


def rewritten_html(url: Column, document: Column, root_name: str = "") -> Column:
    """The document of a page with every kept reference replaced; all other characters stay as they are.

    The document's tokens and the gaps between them take turns; a token that refers to a resource gets the new URL in its
    first attribute of that name. All inside one expression: rows need no key, and nothing is shuffled.
    """

    def token(own: Column, t: Column) -> Column:
        def with_tag(tag: Column) -> Column:
            def with_source(source: Column) -> Column:
                def with_target(to: Column) -> Column:
                    path = F.when(tag == "a", link_path(to, root_name)).otherwise(asset_path(to))
                    return F.when(to.isNotNull(), with_url(t, tag, paths.relative_url(own["path"], path)))

                return F.when(source.isNotNull(), let(target_of(own["base"], source), with_target))

            return F.when(tag.isin(*html.URL_TAGS), let(html.resource_url(tag, html.attributes(t)), with_source))

        return F.coalesce(let(html.tag_name(t), with_tag), t)

    def of(own: Column) -> Column:
        new = F.transform(html.tokens(document), lambda t: token(own, t))
        pieces = F.zip_with(F.split(document, html.TOKEN, -1), new, lambda gap, t: F.concat(gap, F.coalesce(t, F.lit(""))))
        return F.array_join(pieces, "")

    return let(let(urls.parts(url), lambda base: F.struct(base.alias("base"), page_path(base).alias("path"))), of)


def rewritten(pages: DataFrame, root_name: str = "") -> DataFrame:
    """pages with rewritten documents. Rows are rewritten one by one, whatever their page_id; a null document stays null."""
    return pages.withColumn("html", F.coalesce(rewritten_html(F.col("url"), F.col("html"), root_name), F.col("html")))


def with_url(token: Column, tag: Column, new_url: Column) -> Column:
    """An opening tag with a new value for its URL attribute; unchanged if it has none."""
    blank = "^([\\t\\n\\f\\r /]*)"

    def replaced(f: Column) -> Column:
        old = F.get(f["attrs"], f["first"] - 1)
        quoted = F.concat(html.attribute_name(old), F.lit('="'), F.replace(F.replace(new_url, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&#34;")), F.lit('"'))
        before = F.aggregate(F.slice(f["attrs"], F.lit(1), f["first"] - 1), F.regexp_extract(token, "^(<[A-Za-z][^\\t\\n\\f\\r />]*)", 1), lambda s, a: F.concat(s, F.regexp_extract(F.substring(token, F.length(s) + 1, F.length(token)), blank, 1), a))
        upto = let(before, lambda b: F.concat(b, F.regexp_extract(F.substring(token, F.length(b) + 1, F.length(token)), blank, 1)))
        return let(upto, lambda u: F.concat(u, quoted, F.substring(token, F.length(u) + F.length(old) + 1, F.length(token))))

    def of(attrs: Column) -> Column:
        first = F.array_position(F.transform(attrs, lambda a: html.attribute_name(a) == html.url_attribute(tag)), True).cast("int")
        return let(F.struct(attrs.alias("attrs"), first.alias("first")), lambda f: F.when(f["first"] > 0, replaced(f)).otherwise(token))

    return let(html.attributes(token), of)
