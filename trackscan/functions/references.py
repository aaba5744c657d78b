"""Character references of HTML as Column expressions: names, decimal and hexadecimal numbers.

The rules are those of the HTML parser that attribute values are read with: a number names its code
point, but for numbers that no text may hold; a name counts with its semicolon or, for the old
names, also without one and with other letters behind it.
"""

from __future__ import annotations

import json
import re
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A value is cut into these: a reference, or what is between references.
PIECES = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[^\t\n\f <&#;]{1,32};?)|[^&]++|&"
_OLD_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_OLD = "^&(" + "|".join(map(re.escape, _OLD_NAMES)) + ")"
# Nearly all references are these; the others go through the whole table.
_COMMON = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": "\xa0"}

REPLACEMENT = "�"
LAST_POINT = 0x10FFFF
#: What numbers 128 to 159 stand for, as in code page 1252; the rest are themselves.
_WINDOWS = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def _constant(table: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _point(number: Column) -> Column:
    """The character of a code point, from its four bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numbered(digits: Column, base: int) -> Column:
    """The text for a number written in digits of a base."""
    short = F.regexp_replace(digits, "^0+", "")
    n = F.when(F.length(short) > 8, F.lit(LAST_POINT + 1)).otherwise(
        F.coalesce(F.conv(F.when(short == "", "0").otherwise(short), base, 10).cast("long"), F.lit(0))
    )
    windows = F.substr(F.lit(_WINDOWS), (n - 127).cast("int"), F.lit(1))
    wrong = (n == 0) | n.between(0xD800, 0xDFFF) | (n > LAST_POINT)
    control = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127)
    unused = n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when(wrong, REPLACEMENT)
        .when(n.between(128, 159), windows)
        .when(control | unused, "")
        .otherwise(_point(n))
    )


def _named(piece: Column) -> Column:
    """The text for a reference by name; a name that isn't one stays as it stands."""
    whole = F.try_element_at(_constant(html5), F.substr(piece, F.lit(2)))
    old = F.regexp_extract(piece, _OLD, 1)
    rest = F.substr(piece, F.length(old) + 2)
    known = F.try_element_at(_constant({n: html5[n] for n in _OLD_NAMES}), old)
    return F.coalesce(whole, F.when(old != "", F.concat(known, rest)), piece)


def _decoded(piece: Column) -> Column:
    digits = F.regexp_extract(piece, "^&#[xX]?([0-9a-fA-F]+)", 1)
    out = F.when(~piece.startswith("&") | (F.length(piece) == 1), piece)
    for reference, char in _COMMON.items():
        out = out.when(piece == reference, char)
    return (
        out.when(piece.rlike("^&#[xX]"), _numbered(digits, 16))
        .when(piece.startswith("&#"), _numbered(digits, 10))
        .otherwise(_named(piece))
    )


def unescape(text: Column) -> Column:
    """Text with its character references decoded; most texts have none and stay as they are."""
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, _decoded), "")).otherwise(text)
