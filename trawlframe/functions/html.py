"""HTML as Column expressions: a document becomes its tags in order, a tag its attributes.

One regular expression walks over comments, raw-text elements with their contents, and tags, so that nothing
inside a comment, a script or an attribute value is taken for a tag. Tree repair (misnested anchors that an
HTML5 parser would clone) is left out; for well-nested markup the tags are the same.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

_S = r"[\t\n\f\r ]"
_ATTR = rf"[^\t\n\f\r />][^\t\n\f\r />=]*+(?:{_S}*+={_S}*+(?:\"[^\"]*+\"|'[^']*+'|[^\t\n\f\r >\"'][^\t\n\f\r >]*+)?+)?+"
_ATTRS = rf"(?:[\t\n\f\r /]++|{_ATTR})*+"
_RAW = "script|style|textarea|title|noscript|iframe|noembed|noframes|xmp"
#: Comments and declarations; raw-text elements up to their end tag; any other tag.
TOKEN = (
    rf"(?i)<!--(?s:.*?)(?:--!?>|\z)|<[!?][^>]*+>|<({_RAW})(?=[\t\n\f\r />]){_ATTRS}>(?s:.*?)(?=</\1[\t\n\f\r />]|\z)|</?[a-z][^\t\n\f\r />]*+{_ATTRS}>"
)
_OPEN = rf"^<[A-Za-z][^\t\n\f\r />]*+({_ATTRS})>"
URL_TAGS = ("a", "link", "script", "img")
_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def tag_name(token: Column) -> Column:
    """Lower-case name of an opening tag, '' for any other token."""
    return F.lower(F.regexp_extract(token, r"^<([A-Za-z][^\t\n\f\r />]*+)", 1))


def attributes(token: Column) -> Column:
    """The attributes of an opening tag as they stand, in order."""
    return F.regexp_extract_all(F.regexp_extract(token, _OPEN, 1), F.lit(_ATTR), F.lit(0))


def attribute_name(attribute: Column) -> Column:
    return F.lower(F.regexp_extract(attribute, r"^([^\t\n\f\r />][^\t\n\f\r />=]*)", 1))


def unescape(text: Column) -> Column:
    """Character references with a semicolon: the common names, and numbers."""
    pattern = "&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"

    def char(ref: Column) -> Column:
        digits = F.regexp_replace(ref, "[&#xX;]", "")
        code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        safe = let(code, lambda c: F.when((c > 0) & (c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF), c).otherwise(F.lit(0xFFFD)))
        return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")

    def numbers(t: Column) -> Column:
        refs = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), char)
        return F.array_join(F.zip_with(F.split(t, pattern, -1), refs, lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")

    def of(t: Column) -> Column:
        out = F.when(t.contains("&#"), numbers(t)).otherwise(t)
        for name, c in _NAMED.items():
            out = F.replace(out, F.lit(name), F.lit(c))
        return F.when(t.contains("&"), out).otherwise(t)

    return let(text, of)


def attribute_value(attribute: Column) -> Column:
    """The value without its quotes, references decoded; '' where there is none."""
    raw = F.regexp_replace(attribute, rf"^[^\t\n\f\r />][^\t\n\f\r />=]*+{_S}*+=?{_S}*+", "")
    return unescape(let(raw, lambda r: F.when(r.startswith('"') | r.startswith("'"), F.substring(r, F.lit(2), F.length(r) - 2)).otherwise(r)))


def attribute(attrs: Column, name: str) -> Column:
    """The value of the first attribute of that name; null if there is none, '' if it is empty."""
    return attribute_value(F.get(F.filter(attrs, lambda a: attribute_name(a) == name), F.lit(0)))


def url_attribute(tag: Column) -> Column:
    """Which attribute of a tag holds its URL."""
    return F.when(tag.isin("a", "link"), "href").when(tag.isin("script", "img"), "src")


def resource_url(tag: Column, attrs: Column) -> Column:
    """The URL that a tag refers to; a link counts only as a style sheet, by its exact type or rel."""
    sheet = attribute(attrs, "type").eqNullSafe("text/css") | attribute(attrs, "rel").eqNullSafe("stylesheet")
    wanted = F.when(tag.isin("script", "img"), "src").when((tag == "a") | ((tag == "link") & sheet), "href")
    return let(wanted, lambda name: attribute_value(F.get(F.filter(attrs, lambda a: attribute_name(a) == name), F.lit(0))))
