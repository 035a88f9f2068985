import pytest
from pyspark.sql import functions as F

from trawlframe.functions import paths, urls
from trawlframe.operators import extract, saving

BASE = "https://h.example/a/b/p.html?q=1"
#: Reference and what it resolves to; None is not kept.
CASES = {
    "x.html": "https://h.example/a/b/x.html",
    "../x": "https://h.example/a/x",
    "../../../x": "https://h.example/x",
    "/x/./y/../z": "https://h.example/x/z",
    "/x/..": "https://h.example/",
    "?page=2": "https://h.example/a/b/p.html?page=2",
    "?": "https://h.example/a/b/p.html?",
    "": BASE,
    "#s": BASE,
    "x#s": "https://h.example/a/b/x",
    "https://h.example": "https://h.example",
    "HTTPS://h.example/x": "https://h.example/x",
    "//h.example/z": "https://h.example/z",
    "///z": "https://h.example///z",
    "/für": "https://h.example/f%C3%BCr",
    "x y": "https://h.example/a/b/x%20y",
    "/a(b)'c!": "https://h.example/a(b)'c!",
    "/a(b) c": "https://h.example/a%28b%29%20c",
    "/a+b%2Fc": "https://h.example/a+b%2Fc",
    "./a:b": "https://h.example/a/b/a:b",
    "http://h.example/z": "http://h.example/z",
    "mailto:a@b.c": None,
    "javascript:void(0)": None,
    "//o.example/z": None,
    "https://h.example:443/z": None,
    "https://H.example/z": None,
    "https://h.example:x/z": None,
    "https://h example/z": None,
    "/%zz": None,
    "#%zz": None,
    "1:2": None,
    ":x": None,
    "a\nb": None,
    "\x7f": None,
}


def resolved(spark, base, refs):
    rows = spark.createDataFrame([(i, base, "a", r) for i, r in enumerate(refs)], "page_id long, url string, tag string, source_url string")
    out = {r.page_id: r.target if r.kept else None for r in extract.resolved(rows).collect()}
    return [out[i] for i in range(len(refs))]


def test_resolution(spark):
    assert resolved(spark, BASE, CASES) == list(CASES.values())


@pytest.mark.parametrize(("ref", "want"), [("#x", "https://h.example/p#top"), ("", "https://h.example/p#top"), ("x", "https://h.example/x")])
def test_fragment_of_the_page(spark, ref, want):
    assert resolved(spark, "https://h.example/p#top", [ref]) == [want]


def test_userinfo_and_port_are_part_of_the_url(spark):
    assert resolved(spark, "http://u:p@h.example:8080/a", ["b", "//h.example:8080/c"]) == ["http://u:p@h.example:8080/b", "http://h.example:8080/c"]


def test_save_paths(spark):
    md5 = {"https://h": "73d5d6386ccb9375aab434d36e6293f0", "https://h/": "bd35d688dc5e6261c48daf070b455f05"}
    want = {
        "https://h": ("index.html", md5["https://h"] + ".html", md5["https://h"]),
        "https://h/": ("/index.html", f"/{md5['https://h/']}.html", "/" + md5["https://h/"]),
        "https://h/a": ("/a.html", "/a.html", "/a"),
        "https://h/a.html": ("/a.html.html", "/a.html.html", "/a.html"),
        "https://h/a/b/": ("/a/b/b.html", "/a/b/b.html", "/a/b/b"),
        "https://h/a/b?x=1": ("/a/b.html", "/a/b.html", "/a/b"),
        "https://h/f%C3%BCr": ("/für.html", "/für.html", "/für"),
        "https://h/a+b%2Bc": ("/a+b+c.html", "/a+b+c.html", "/a+b+c"),
    }
    rows = spark.createDataFrame([(u,) for u in want], "url string").withColumn("p", urls.parts(F.col("url")))
    p = F.col("p")
    found = rows.select("url", saving.page_path(p).alias("a"), saving.link_path(p).alias("b"), saving.asset_path(p).alias("c")).collect()
    assert {r.url: (r.a, r.b, r.c) for r in found} == want
    mended = rows.filter("url = 'https://h/'").select(saving.link_path(p, "index").alias("x")).first()
    assert mended.x == "/index.html"


def test_relative_urls(spark):
    cases = [
        ("/web_sample1.html.html", "/web_glossary.html.html", "./web_glossary.html.html"),
        ("/web_sample1.html.html", "/common-data/document.css", "./common-data/document.css"),
        ("/en/98.html", "/The.html", "../The.html"),
        ("/a/b/b.html", "/a/b/c.html", "./c.html"),
        ("/a/b/c/d.html", "/a/x/y.html", "../../x/y.html"),
        ("/a.html", "/.well-known/x", ".well-known/x"),
        ("index.html", "/x/y.html", "./y.html"),
        ("/a/b.html", "/a", "."),
    ]
    rows = spark.createDataFrame(cases, "page string, target string, want string")
    for r in rows.withColumn("got", paths.relative_url(F.col("page"), F.col("target"))).collect():
        assert r.got == r.want, r


@pytest.mark.parametrize(("path", "want"), [("", "."), ("/", "/"), ("a/../..", ".."), ("/../a", "/a"), ("a//b/./c/", "a/b/c"), ("a/b/../../..", "..")])
def test_clean(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(paths.clean(F.col("p")).alias("c")).first().c == want
