"""Slash paths as Column expressions: cleaning, splitting, save paths, relative links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def clean(path: Column) -> Column:
    """The shortest equal path: no empty or '.' elements, '..' resolved as far as it can be; '' becomes '.'."""

    def of(p: Column) -> Column:
        rooted = p.startswith("/")

        def add(stack: Column, part: Column) -> Column:
            up = (F.size(stack) > 0) & (F.get(stack, F.size(stack) - 1) != "..")
            return (
                F.when((part == "") | (part == "."), stack)
                .when((part == "..") & up, F.slice(stack, F.lit(1), F.size(stack) - 1))
                .when((part == "..") & rooted, stack)
                .otherwise(F.concat(stack, F.array(part)))
            )

        joined = F.array_join(F.aggregate(F.split(p, "/", -1), F.array().cast("array<string>"), add), "/")
        whole = let(joined, lambda j: F.when(rooted, F.concat(F.lit("/"), j)).when(j == "", ".").otherwise(j))
        return F.when(~p.rlike(r"//|(?:^|/)\.\.?(?:/|$)|.+/$") & (p != ""), p).otherwise(whole)

    return let(path, of)


def directory(path: Column) -> Column:
    """All but what follows the last slash, cleaned."""
    return clean(F.regexp_replace(path, "[^/]*$", ""))


def base_name(path: Column) -> Column:
    """The last element, trailing slashes aside: '.' for no path, '/' for slashes alone."""
    return let(path, lambda p: F.when(p == "", ".").otherwise(let(F.regexp_extract(p, "([^/]*)/*$", 1), lambda last: F.when(last == "", "/").otherwise(last))))


def save_path(path: Column, url: Column, fallback: str, ext: str) -> Column:
    """Where a resource is saved: its decoded path, with a fallback name at a root and MD5 of the URL where there is none; ext is always added."""

    def of(p: Column) -> Column:
        name = let(base_name(p), lambda b: F.when(~b.isin(".", "/"), b).otherwise(F.lit(fallback) if fallback else F.md5(url)))
        joined = let(directory(p), lambda d: clean(F.when(d == ".", name).otherwise(F.concat(d, F.lit("/"), name))))
        return F.concat(joined, F.lit(f".{ext}")) if ext else joined

    return let(path, of)


def _below(start: Column, goal: Column) -> Column:
    """The way from one cleaned path to another, both rooted or neither."""
    parts = lambda p: F.filter(F.split(p, "/", -1), lambda x: (x != "") & (x != "."))

    def of(a: Column, b: Column) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        shared = let(F.array_position(same, False).cast("int"), lambda n: F.when(n > 0, n - 1).otherwise(F.least(F.size(a), F.size(b))))
        way = let(shared, lambda n: F.concat(F.array_repeat(F.lit(".."), (F.size(a) - n).cast("int")), F.slice(b, n + 1, F.size(b))))
        return let(F.array_join(way, "/"), lambda r: F.when(r == "", ".").when(r.startswith("."), r).otherwise(F.concat(F.lit("./"), r)))

    return let(F.struct(parts(start).alias("a"), parts(goal).alias("b")), lambda s: of(s["a"], s["b"]))


def relative_url(page_path: Column, target: Column) -> Column:
    """A link from the page's folder to the target, beginning with a dot; './' and the last element if only one of them is rooted."""
    ends = F.struct(directory(page_path).alias("start"), clean(target).alias("goal"), target.alias("target"))
    alone = lambda e: F.concat(F.lit("./"), base_name(e["target"]))
    return let(ends, lambda e: F.when(e["start"].startswith("/") == e["goal"].startswith("/"), _below(e["start"], e["goal"])).otherwise(alone(e)))
