"""Enhanced detection: exact script hosts and fingerprinting rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.fixed_values import HOST_INTELLIGENCE
from trackscan.functions.lex import attribute, snippet
from trackscan.functions.match import fold, needed_texts, pattern_hits, strings, texts_found
from trackscan.functions.urls import netloc

# Fixed values: (source, type, category, risk, purpose, method, patterns).
FINGERPRINT_RULES = [
    (
        "canvas_fingerprinting",
        "fingerprinting",
        "privacy_invasion",
        "high",
        "device_fingerprinting",
        "canvas_fingerprinting",
        [r"canvas\.toDataURL", r"""getContext\(["\']2d["\']\)"""],
    ),
    (
        "webrtc_detection",
        "webrtc_leak",
        "privacy_invasion",
        "high",
        "ip_leak",
        "webrtc_stun",
        ["RTCPeerConnection", "webkitRTCPeerConnection"],
    ),
    (
        "font_fingerprinting",
        "fingerprinting",
        "privacy_invasion",
        "medium",
        "font_fingerprinting",
        "font_enumeration",
        ["@font-face", "fontface", "measureText"],
    ),
]


def tracker(kind, domain, source, category, risk, purpose, seen, details) -> Column:
    """A tracker row; `details` is a list of (key, value)."""
    return F.struct(
        kind.alias("tracker_type"),
        domain.alias("domain"),
        source.alias("source"),
        category.alias("category"),
        risk.alias("risk_level"),
        purpose.alias("purpose"),
        seen.alias("first_seen"),
        F.create_map(*[c for key, value in details for c in (F.lit(key), value)]).alias("details"),
    )


def external_scripts(elements: Column) -> Column:
    """Scripts with a source, as array<struct<src, domain, source>>."""
    found = F.filter(elements, lambda e: (e["tag"] == "script") & ~e["in_noscript"])
    read = F.transform(
        found,
        lambda e: F.struct(
            attribute(e["attrs"], "src").alias("src"),
            netloc(attribute(e["attrs"], "src")).alias("domain"),
            snippet(e["source"]).alias("element"),
        ),
    )
    return F.filter(read, lambda s: s["src"] != "")


def host_trackers(
    elements: Column, seen: Column, intel: Sequence[tuple] = HOST_INTELLIGENCE
) -> Column:
    """Scripts whose host equals a listed host; a port or subdomain is a different host."""
    known = F.array(
        *[
            F.struct(*[F.lit(v).alias(n) for n, v in zip(INTEL_FIELDS, row)])
            for row in intel
        ]
    )

    def rows(script: Column) -> Column:
        return F.transform(
            F.filter(known, lambda k: k["domain"] == script["domain"]),
            lambda k: tracker(
                F.lit("javascript"),
                script["domain"],
                script["src"],
                k["category"],
                k["risk"],
                k["purpose"],
                seen,
                [("element", script["element"])],
            ),
        )

    return F.flatten(F.transform(external_scripts(elements), rows))


INTEL_FIELDS = ("domain", "category", "risk", "purpose")


def join_hosts(scripts: DataFrame, intel: DataFrame) -> DataFrame:
    """Script rows with a `domain` against a user table of hosts, on equality."""
    return scripts.join(intel, "domain")


_PATTERNS = [p for rule in FINGERPRINT_RULES for p in rule[-1]]
_TEXTS = needed_texts(_PATTERNS)


def fingerprint_hits(html: Column) -> Column:
    """The rule patterns that a page text contains, the expensive part of the rules."""
    with_found = F.transform(
        F.array(texts_found(fold(html), _TEXTS)), lambda found: pattern_hits(_PATTERNS, html, found)
    )
    return F.get(with_found, F.lit(0))


def fingerprint_trackers(hits: Column, url: Column, seen: Column) -> Column:
    """One row per fingerprinting rule that the page text meets."""
    rows = []
    for source, kind, category, risk, purpose, method, patterns in FINGERPRINT_RULES:
        row = tracker(
            F.lit(kind),
            netloc(url),
            F.lit(source),
            F.lit(category),
            F.lit(risk),
            F.lit(purpose),
            seen,
            [("method", F.lit(method))],
        )
        rows.append(F.when(F.arrays_overlap(hits, strings(patterns)), row))
    return F.array_compact(F.array(*rows))
