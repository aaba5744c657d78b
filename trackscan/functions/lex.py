"""HTML tokens, elements and attributes as Column expressions.

A page stays one row: the lexer is one regular expression, its matches are an array, and
attribute reads are array functions on it. Repeated groups are possessive, because the JVM
matcher recurses on backtracking groups and overflows its stack on tags of a few hundred KB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackscan.functions.references import unescape

# Text of a tag up to its closing bracket. A quote opens only as the start of a value, and then
# hides brackets up to its end, or the end of the page.
AT = r"""(?:[^>=]++|=++\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+)*+"""


_END = {name: rf"</{name}\s*+>" for name in ("script", "style", "noscript")}


def _named(name: str) -> str:
    """The rest of an opening tag after its bracket."""
    return rf"{name}(?:[\s/]{AT})?>"


def _raw_text(name: str) -> str:
    """A raw-text element: up to its end tag or the end of the page, unless self-closing."""
    return rf"{_named(name)}(?:(?<=/>)|.*?(?:{_END[name]}|\z))"


# Alternatives share the opening bracket, so text between tags is passed over in one step each.
# What is left open takes the rest of the page, so that no character is read again from every
# bracket before it: a comment and a noscript block as they are, a tag as no token.
_SKIPPED = rf"!--.*?(?:-->|\z)|{_raw_text('script')}|{_raw_text('style')}"
_TAG = f"/?[a-z][a-z0-9]*{AT}"
TOKEN = rf"(?is)(<(?:{_SKIPPED}|{_TAG}>))|<{_TAG}\z"
NOSCRIPT = rf"(?is)<(?:{_SKIPPED}|{_named('noscript')}.*?(?:{_END['noscript']}|\z)|{_TAG}(?:>|\z))"
TAG = r"^<([a-zA-Z][^\s/>]*)"
HEAD = rf"(?s)^<[a-zA-Z][^\s/>]*({AT})>"
BODY = rf"(?is)^<(?:script|style)(?:[\s/]{AT})?>(.*?)(?:</(?:script|style)\s*>)?\z"
ATTRIBUTE = r"""([^\s>/=]++)(?:\s*+=++\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?"""

# Tokens that any detection rule can use: the five tags, or an inline background image.
RELEVANT = r"(?is)^<(?:img|iframe|script|style|meta)[\s/>]|^<[a-z][^\s/>]*[\s/].*background-image"

def tokens(html: Column) -> Column:
    """Every comment, tag, script and style of a page in document order."""
    # a tag left open is outside the group, and so an empty token
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(1))


def opening_tokens(html: Column) -> Column:
    return F.filter(tokens(html), lambda t: t.rlike("^<[a-zA-Z]"))


def noscript_tokens(html: Column) -> Column:
    """Opening tokens inside the noscript blocks of a page."""
    blocks = F.filter(
        F.regexp_extract_all(html, F.lit(NOSCRIPT), F.lit(0)),
        lambda t: t.rlike(r"(?i)^<noscript[\s/>]"),
    )
    inner = F.flatten(F.transform(blocks, opening_tokens))
    # Pages without the tag skip the second pass.
    return F.when(html.rlike("(?i)<noscript"), inner).otherwise(F.expr("cast(array() as array<string>)"))


def attributes(head: Column) -> Column:
    """All attributes of a tag, in order, as array<struct<name, value>>."""

    def clean(raw: Column) -> Column:
        value = raw["value"]
        quoted = value.rlike("^[\"']")
        bare = F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(F.lower(raw["name"]).alias("name"), unescape(bare).alias("value"))

    names = F.regexp_extract_all(head, F.lit(ATTRIBUTE), F.lit(1)).alias("name")
    values = F.regexp_extract_all(head, F.lit(ATTRIBUTE), F.lit(2)).alias("value")
    return F.transform(F.arrays_zip(names, values), clean)


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute or ''; of repeated attributes the last counts."""
    found = F.filter(attrs, lambda a: a["name"] == name)
    return F.coalesce(F.try_element_at(found, F.lit(-1))["value"], F.lit(""))


def has_attribute(attrs: Column, name: str) -> Column:
    return F.exists(attrs, lambda a: a["name"] == name)


def body(token: Column) -> Column:
    """Text of a script or style element; '' for every other element."""
    return F.regexp_extract(token, BODY, 1)


def element(token: Column, pos: Column, in_noscript: Column) -> Column:
    tag = F.lower(F.regexp_extract(token, TAG, 1))
    return F.struct(
        pos.cast("int").alias("pos"),
        tag.alias("tag"),
        in_noscript.alias("in_noscript"),
        attributes(F.regexp_extract(token, HEAD, 1)).alias("attrs"),
        F.when(token.rlike(r"(?i)^<s(?:cript|tyle)[\s/>]"), body(token)).otherwise("").alias("body"),
        token.alias("source"),
    )


def _elements(found: Column, in_noscript: bool) -> Column:
    return F.transform(found, lambda t, i: element(t, i, F.lit(in_noscript)))


def all_elements(html: Column) -> Column:
    """Every element of a page in document order."""
    return _elements(opening_tokens(html), False)


def scan_elements(html: Column) -> Column:
    """The elements detection needs: document pass first, then the noscript pass."""
    page = F.filter(tokens(html), lambda t: t.rlike(RELEVANT))
    hidden = F.filter(noscript_tokens(html), lambda t: t.rlike(r"(?i)^<(?:img|iframe)[\s/>]"))
    return F.concat(_elements(page, False), _elements(hidden, True))


def snippet(token: Column, size: int = 200) -> Column:
    return F.substring(token, 1, size)
