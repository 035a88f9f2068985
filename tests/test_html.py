import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from trawlframe.functions import html, urls
from trawlframe.operators import extract, saving
from trawlframe.session import table
from trawlframe.sources import tables

PAGE = """<!DOCTYPE html><HEAD><!-- <a href=comment> --><title><a href=title></title>
<link rel="stylesheet preload" href=no1><link type="text/css"><LINK REL=stylesheet HREF='a.css'><link type="text/css" href=b.css>
<script>var x = "<a href='script'>"; // <!--</script><SCRIPT SRC=app.js async></SCRIPT><noscript><img src=noscript></noscript>
<style>a{}<a href=style></style></HEAD><a name=x>n</a><a data-href=d>d</a><img src=""><IMG alt=">" SRC = "i.png"/>
<a href="one" href="two">1</a><a title="x href=y" href='q?a=1&amp;b=2'>2</a><a href=un/quoted>3</a><a href>4</a><a href="&#x2F;n&#252;m&#x1F600;">5</a>
<a
 href="
nl">6</a><aside href=no><a href=x"y>7</a></aside><textarea><a href=text></textarea></a href=end><a href="unclosed"""


def found(spark, page):
    pages = spark.createDataFrame([(1, "https://h.example/d/p", page)], "page_id long, url string, html string")
    return [(r.tag, r.source_url) for r in extract.resources(pages).orderBy("pos").collect()]


def test_edge_cases(spark):
    assert found(spark, PAGE) == [
        ("link", "a.css"), ("link", "b.css"), ("script", "app.js"), ("img", ""), ("img", "i.png"), ("a", "one"), ("a", "q?a=1&b=2"),
        ("a", "un/quoted"), ("a", ""), ("a", "/nüm😀"), ("a", "\nnl"), ("a", 'x"y'),
    ]


def test_long_and_empty_documents(spark):
    assert found(spark, "") == [] and found(spark, None) == []
    many = "<a " + "x " * 20_000 + "href=u>" + "<b>" * 20_000 + "<!--" + "-" * 50_000
    assert found(spark, many) == [("a", "u")]


class Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out = []

    def handle_starttag(self, tag, attrs):
        first = dict(reversed(attrs))
        if tag in ("script", "img") and "src" in first:
            self.out.append((tag, first["src"]))
        if tag == "a" and "href" in first:
            self.out.append((tag, first["href"]))


def test_same_as_a_parser_on_all_pages(spark, sf):
    pages = table(spark, sf, "pages")
    got = {}
    for r in extract.resources(pages).orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append((r.tag, r.source_url))
    for r in pages.collect():
        reader = Reader()
        reader.feed(r.html)
        assert got.get(r.page_id, []) == reader.out


def test_attribute_map_takes_the_first(spark):
    pages = spark.createDataFrame([(1, "u", '<a href=1 HREF=2 id="x">')], "page_id long, url string, html string")
    r = extract.resources(pages).select(extract.attribute_map(F.col("attrs")).alias("m")).first()
    assert r.m == {"href": "1", "id": "x"}


def test_rewriting_leads_to_saved_pages_and_keeps_the_rest(spark, sf):
    pages = tables.asset_pages(spark, sf)
    new = {r.page_id: r.html for r in saving.rewritten(pages).collect()}
    place = {r.page_id: r.save_path for r in saving.with_page_path(pages).collect()}
    rows = saving.rewrite_map(pages).collect()
    targets = {r.page_id: [] for r in pages.collect()}
    for r in sorted(rows, key=lambda r: r.pos):
        targets[r.page_id].append(r.new_url)
    for r in pages.collect():
        strip = lambda t: re.sub(r"""(href|src)=("[^"]*"|[^ >]*)""", r"\1", t)
        assert strip(new[r.page_id]) == strip(r.html)
        reader = Reader()
        reader.feed(new[r.page_id])
        seen = [u for _, u in reader.out if not u.startswith(("https://cdn", "mailto:"))]
        assert sorted(seen) == sorted(t for t in targets[r.page_id] if ".css" not in t)
    again = saving.rewrite_map(pages).withColumn("page", F.lit(1)).filter("tag = 'img'").collect()
    for r in again:
        if place[r.page_id].startswith("/"):
            assert urljoin("http://h" + place[r.page_id], r.new_url).endswith(f"/img/{r.page_id % 7}.png")


def test_unsupported_tags_are_left_alone(spark):
    row = spark.createDataFrame([('<b href="x">', "b", "n"), ("<a name=x>", "a", "n"), ('<a id=1 href="x" class=c>', "a", 'n&"')], "t string, tag string, u string")
    got = [r.x for r in row.select(saving.with_url(F.col("t"), F.col("tag"), F.col("u")).alias("x")).collect()]
    assert got == ['<b href="x">', "<a name=x>", '<a id=1 href="n&amp;&#34;" class=c>']


def test_names(spark):
    r = spark.range(1).select(html.unescape(F.lit("&lt;&amp;lt;&#0;&copy;")).alias("x"), urls.encode_path(F.lit("a b*~é/")).alias("y")).first()
    assert r.x == "<&lt;�&copy;" and r.y == "a%20b%2A~%C3%A9/"
