"""URLs as Column expressions: parsing, validity, resolution (RFC 3986, 5.2), percent-encoding, text form.

A URL is taken apart once into a struct and put together again; every step is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: scheme, authority, path, query, fragment, each with its mark (RFC 3986, appendix B). A scheme begins with a letter;
#: without one, three slashes are a path.
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*+):)?+((?<=:)//[^/?#]*+|^//(?!/)[^/?#]*+|)([^?#]*+)(\?[^#]*+)?+(#.*+)?+\z"
_BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"
#: What a path may hold as it is; a path with anything else is decoded and encoded anew.
_PLAIN_PATH = r"^[A-Za-z0-9\-_.~$&+,/:;=@!'()*\[\]%]*$"
_USERINFO = r"^[A-Za-z0-9\-._:~!$&'()*+,;=%@]*$"
_HOST = r"^(?:[A-Za-z0-9\-._~!$&'()*+,;=:\[\]<>\"]|[^\x00-\x7F]|%[89A-Fa-f][0-9A-Fa-f])*$"
#: url_encode's output for characters that a path keeps, and what it does otherwise than percent-encoding.
_KEPT = {"+": "%20", "*": "%2A", "%7E": "~", "%24": "$", "%26": "&", "%2B": "+", "%2C": ",", "%2F": "/", "%3A": ":", "%3B": ";", "%3D": "=", "%40": "@"}


def parts(url: Column) -> Column:
    """scheme (lower case), opaque, user, host (with port), path, query and fragment; a part that is absent is null, but host and path are ''."""
    optional = lambda text: F.when(text != "", F.substring(text, F.lit(2), F.length(text)))

    def of(m: Column) -> Column:
        authority = F.when(m["authority"] != "", F.substring(m["authority"], F.lit(3), F.length(m["authority"])))
        opaque = (m["scheme"] != "") & (m["authority"] == "") & (m["path"] != "") & ~m["path"].startswith("/")
        return F.struct(
            F.when(m["scheme"] != "", m["scheme"]).alias("scheme"),
            F.when(opaque, m["path"]).alias("opaque"),
            F.when(authority.contains("@"), F.regexp_extract(authority, "(?s)^(.*)@", 1)).alias("user"),
            F.coalesce(F.regexp_replace(authority, "(?s)^.*@", ""), F.lit("")).alias("host"),
            F.when(opaque, F.lit("")).otherwise(m["path"]).alias("path"),
            optional(m["query"]).alias("query"),
            optional(m["fragment"]).alias("fragment"),
        )

    names = ["scheme", "authority", "path", "query", "fragment"]
    marked = F.struct(*[(F.lower(F.regexp_extract(url, _PARTS, 1)) if n == "scheme" else F.regexp_extract(url, _PARTS, i + 1)).alias(n) for i, n in enumerate(names)])
    return let(marked, of)


def valid(url: Column, p: Column) -> Column:
    """Whether the text is a URL or reference at all: no control characters, no bad escapes, no scheme-like first segment, a numeric port."""
    before = without_fragment(url)
    colon = p["scheme"].isNull() & F.regexp_extract(before, r"^([^/?]*)", 1).contains(":")
    port = p["host"].rlike(r"^[^\[\]]*:(?![0-9]*$)|\]:(?![0-9]*$)|\][^:]")
    bad = (
        before.rlike(r"[\x00-\x1F\x7F]")
        | colon
        | p["path"].rlike(_BAD_ESCAPE)
        | F.coalesce(p["fragment"].rlike(_BAD_ESCAPE), F.lit(False))
        | port
        | ~p["host"].rlike(_HOST)
        | F.coalesce(~p["user"].rlike(_USERINFO), F.lit(False))
    )
    return url.isNotNull() & ~bad


def decode(text: Column) -> Column:
    """Percent-decoding; '+' stays. Null if an escape is bad."""
    return let(text, lambda t: F.when(t.contains("%"), F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B")))).otherwise(t))


def encode_path(text: Column) -> Column:
    out = F.url_encode(text)
    for found, kept in _KEPT.items():
        out = F.replace(out, F.lit(found), F.lit(kept))
    return out


def escaped_path(path: Column) -> Column:
    """The path's text form: as it is if that is a valid encoding, else encoded anew."""
    return let(path, lambda p: F.when(p.rlike(_PLAIN_PATH), p).otherwise(encode_path(decode(p))))


def without_dots(path: Column) -> Column:
    """'.' and '..' segments resolved; '' stays, anything else gets a leading slash and keeps a folder's trailing one."""

    def add(stack: Column, part: Column) -> Column:
        popped = F.when(F.size(stack) > 0, F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(stack)
        return F.when(part == ".", stack).when(part == "..", popped).otherwise(F.concat(stack, F.array(part)))

    def of(p: Column) -> Column:
        kept = F.array_join(F.aggregate(F.split(p, "/", -1), F.array().cast("array<string>"), add), "/")
        full = F.concat(F.lit("/"), kept, F.when(p.rlike(r"(?:^|/)\.\.?$"), "/").otherwise(""))
        single = let(full, lambda f: F.when(f.startswith("//"), F.substring(f, F.lit(2), F.length(f))).otherwise(f))
        return F.when((p == "") | (p.startswith("/") & ~p.rlike(r"/\.\.?(?:/|$)")), p).otherwise(single)

    return let(path, of)


def resolve(base: Column, ref: Column) -> Column:
    """The struct of a reference seen from a base, both structs of parts(); paths come out in text form."""

    def of(base: Column, ref: Column, own: Column, bare: Column, base_path: Column, ref_path: Column) -> Column:
        merged = F.when(ref_path == "", base_path).when(ref_path.startswith("/"), ref_path).otherwise(F.concat(F.regexp_extract(base_path, "^(.*/)", 1), ref_path))
        pick = lambda name: F.when(own, ref[name]).otherwise(base[name])
        return F.struct(
            F.coalesce(ref["scheme"], base["scheme"]).alias("scheme"),
            ref["opaque"].alias("opaque"),
            pick("user").alias("user"),
            pick("host").alias("host"),
            without_dots(F.when(own, ref_path).otherwise(merged)).alias("path"),
            F.when(~own & bare, base["query"]).otherwise(ref["query"]).alias("query"),
            F.when(~own & bare & ref["fragment"].isNull(), base["fragment"]).otherwise(ref["fragment"]).alias("fragment"),
        )

    facts = F.struct(
        base.alias("base"),
        ref.alias("ref"),
        (ref["scheme"].isNotNull() | (ref["host"] != "") | ref["user"].isNotNull()).alias("own"),
        ((ref["path"] == "") & ref["query"].isNull()).alias("bare"),
        escaped_path(base["path"]).alias("base_path"),
        escaped_path(ref["path"]).alias("ref_path"),
    )
    return let(facts, lambda f: of(*[f[n] for n in ("base", "ref", "own", "bare", "base_path", "ref_path")]))


def text(p: Column) -> Column:
    """The URL's text form, which is its identity."""

    def of(p: Column) -> Column:
        rooted = let(escaped_path(p["path"]), lambda path: F.when((path != "") & ~path.startswith("/") & (p["host"] != ""), F.concat(F.lit("/"), path)).otherwise(path))
        has_place = (p["host"] != "") | p["user"].isNotNull() | (p["scheme"].isNotNull() & (p["path"] != ""))
        place = F.when(has_place, F.concat(F.lit("//"), F.coalesce(F.concat(p["user"], F.lit("@")), F.lit("")), p["host"])).otherwise("")
        return F.concat(
            F.coalesce(F.concat(p["scheme"], F.lit(":")), F.lit("")),
            F.coalesce(p["opaque"], F.concat(place, rooted)),
            F.coalesce(F.concat(F.lit("?"), p["query"]), F.lit("")),
            F.coalesce(F.concat(F.lit("#"), F.when(p["fragment"] != "", p["fragment"])), F.lit("")),
        )

    return let(p, of)


def decoded_path(p: Column) -> Column:
    return let(p["path"], lambda path: F.coalesce(decode(path), path))


def without_fragment(ref: Column) -> Column:
    return F.regexp_replace(ref, "(?s:#.*)$", "")
