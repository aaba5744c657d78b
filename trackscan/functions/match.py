"""Substring and pattern matching against the fixed lists.

Lists of known size are literals in the expression, so a page is matched inside its own task
with no join. Ignoring case follows the Unicode rules of ``(?iu)``. Most patterns are plain
text, and all of those are looked for in one pass over the case-folded text. Patterns are
always literals of the plan, so each is compiled once per task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackscan.fixed_values import TRACKER_DOMAINS

IGNORE_CASE = "(?idU)"

_SPECIAL = set(r"\.^$*+?{}[]|()")
# Letters outside ASCII that match i, s or k when case is ignored.
_FOLD_FROM, _FOLD_TO = "İıſK", "iisk"


def strings(values: Sequence[str]) -> Column:
    """A constant array; one literal that folds, instead of one column object per value."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


# Alternatives tried one by one before they are split by a test on the first letter.
_GROUP = 5
# Up to this many texts a search for each is cheaper than one for all.
_FEW_TEXTS = 16


def any_of(texts: Sequence[str]) -> str:
    """Regular expression for the longest of the texts, with shared beginnings merged.

    Where no text starts it fails after a few letter tests instead of one try per text.
    """
    tails: dict[str, list[str]] = {}
    for value in sorted(set(texts)):
        tails.setdefault(value[:1], []).append(value[1:])
    ends = tails.pop("", None) is not None
    branches = [(re.escape(head), re.escape(head) + any_of(rest)) for head, rest in tails.items()]
    if not branches:
        return ""
    if len(branches) == 1 and not ends:
        return branches[0][1]
    options = [branch for _, branch in branches]
    if len(branches) > _GROUP:
        groups = [branches[i : i + _GROUP] for i in range(0, len(branches), _GROUP)]
        options = [
            f"(?=[{''.join(h for h, _ in g)}])(?:{'|'.join(b for _, b in g)})" for g in groups
        ]
    return f"(?:{'|'.join(options)})" + ("?" if ends else "")


def texts_found(text: Column, texts: Sequence[str]) -> Column:
    """Texts that occur in the text, each once.

    Many texts are looked for in one pass. It is a lookahead, so texts that overlap are all
    found; of those that start at one position the longest is reported, and a shorter one is
    a beginning of it.
    """
    if len(texts) <= _FEW_TEXTS:
        # One element wide, so that the text is computed once and not once per search.
        searched = F.transform(
            F.array(text), lambda x: F.filter(strings(texts), lambda t: x.contains(t))
        )
        return F.get(searched, F.lit(0))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({any_of(texts)}))"), F.lit(1)))


def first_domain(text: Column, domains: Sequence[str] = TRACKER_DOMAINS) -> Column:
    """First listed domain contained in the text, in list order, else null.

    Most addresses contain none; one search rules them out before the list is gone through.
    """
    found = F.filter(strings(domains), lambda d: text.contains(d))
    return F.when(text.rlike(any_of(domains)), F.get(found, F.lit(0)))


def fold(text: Column) -> Column:
    """Lower-cased text in which every letter that matches an ASCII one is that letter."""
    ascii_only = F.length(text) == F.octet_length(text)
    wide = F.lower(F.translate(text, _FOLD_FROM, _FOLD_TO))
    return F.when(ascii_only, F.lower(text)).otherwise(wide)


def plain_text(pattern: str) -> str | None:
    """The text a pattern stands for, if it is plain text with escaped punctuation."""
    out, chars = [], iter(pattern)
    for char in chars:
        if char == "\\":
            char = next(chars, "")
            if not char or char.isalnum():
                return None
        elif char in _SPECIAL:
            return None
        out.append(char)
    text = "".join(out)
    return text.lower() if text.isascii() else None


def required_text(pattern: str) -> str | None:
    """A piece of plain text every match must contain, found only in simple sequences."""
    if "|" in pattern or "{" in pattern or re.search(r"\(\?|(?<!\\)\(", pattern):
        return None
    pieces = re.split(r"\\[sSdDwW][*+?]*|(?<!\\)\[[^\]]*\][*+?]*|(?<!\\)\.[*+?]*", pattern)
    texts = [plain_text(p) for p in pieces if p]
    if not texts or any(t is None for t in texts):
        return None
    return max(texts, key=len)


def needed_texts(patterns: Sequence[str]) -> list[str]:
    """For each pattern the plain text it is, or cannot match without."""
    needed = (plain_text(p) or required_text(p) for p in patterns)
    return sorted({n for n in needed if n})


def pattern_rows(patterns: Sequence[str], texts: Sequence[str]) -> list[dict]:
    """Per pattern its rule: `needs`, the found texts of which one must be there, `plain`."""
    rows = []
    for pattern in patterns:
        plain = plain_text(pattern)
        piece = plain or required_text(pattern)
        needs = [t for t in texts if piece and t.startswith(piece)]
        rows.append({"pattern": pattern, "needs": needs, "plain": plain is not None})
    return rows


RULE = "pattern:string,needs:array<string>,plain:boolean"


def rules(rows: Sequence[dict], fields: str = RULE) -> Column:
    """Constant array of rules, a single literal of the plan."""
    return F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{fields}>>")


def rule_holds(rule: Column, patterns: Sequence[str], text: Column, found: Column) -> Column:
    """Whether the pattern of a rule occurs in the text, ignoring case.

    `found` holds the texts that the case-folded text contains. That settles plain text; a
    real regular expression runs only where the text it cannot do without is there. Those
    are branches of their own because only a literal pattern is compiled just once.
    """
    real = F
    for pattern in dict.fromkeys(patterns):
        if plain_text(pattern) is None:
            real = real.when(rule["pattern"] == pattern, text.rlike(IGNORE_CASE + pattern))
    candidate = (F.size(rule["needs"]) == 0) | F.arrays_overlap(found, rule["needs"])
    return candidate & (rule["plain"] if real is F else rule["plain"] | real.otherwise(False))


def pattern_hits(patterns: Sequence[str], text: Column, found: Column) -> Column:
    """All patterns that occur in the text, in list order.

    `found` is `texts_found` of the case-folded text for `needed_texts` of the patterns.
    """
    if not patterns:
        return strings([])
    rows = pattern_rows(patterns, needed_texts(patterns))
    hits = F.transform(
        F.filter(rules(rows), lambda rule: rule_holds(rule, patterns, text, found)),
        lambda rule: rule["pattern"],
    )
    if any(not row["needs"] for row in rows):
        return hits
    # Without any of the texts no pattern can match.
    return F.when(F.size(found) > 0, hits).otherwise(strings([]))
