"""Privacy score, risk label, categories and advice of a scanned page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackscan.fixed_values import CATEGORY_DOMAINS
from trackscan.functions.match import strings
from trackscan.params import DEFAULT_PARAMS, ScoringParams

# Categories whose hosts count as high risk.
HIGH_RISK_CATEGORIES = ("advertising", "social_media")

# Advice per condition, in the order it is given.
ADVERTISING_ADVICE = [
    "Consider using ad blockers or privacy-focused browsers",
    "Review and adjust ad personalization settings",
]
SOCIAL_ADVICE = [
    "Disable social media tracking in browser settings",
    "Use privacy extensions to block social media trackers",
]
HIGH_RISK_ADVICE = ["High-risk tracking domains detected - consider VPN usage"]
ANALYTICS_ADVICE = ["Analytics tracking detected - consider opting out if possible"]
DEFAULT_ADVICE = ["Minimal tracking detected - privacy impact is low"]


def in_category(domain: Column, category: str) -> Column:
    return F.exists(strings(CATEGORY_DOMAINS[category]), lambda c: domain.contains(c))


def domain_categories(domain: Column) -> Column:
    """Sorted categories of one domain."""
    return categories(F.array(domain))


def categories(domains: Column) -> Column:
    """Sorted set of the categories that any of the domains belongs to."""
    tests = [
        F.when(F.exists(domains, _belongs(name)), F.lit(name)) for name in CATEGORY_DOMAINS
    ]
    return F.array_sort(F.array_compact(F.array(*tests)))


def _belongs(category: str):
    return lambda domain: in_category(domain, category)


def high_risk(domains: Column) -> Column:
    """High-risk domains as a bag: repeated domains stay repeated, once per category hit."""
    hits = F.transform(
        domains,
        lambda d: F.array_compact(
            F.array(*[F.when(in_category(d, c), d) for c in HIGH_RISK_CATEGORIES])
        ),
    )
    return F.flatten(hits)


def count_scripts(scripts: Column, kind: str) -> Column:
    return F.size(F.filter(scripts, lambda s: s["type"] == kind))


def score_value(
    pixels: Column, external: Column, inline: Column, risky: Column, params: ScoringParams
) -> Column:
    """100 minus the weighted counts, not below zero."""
    lost = (
        pixels * F.lit(params.tracking_pixel)
        + external * F.lit(params.external_script)
        + inline * F.lit(params.inline_script)
        + risky * F.lit(params.high_risk_domain)
    )
    return F.greatest(F.lit(0), F.lit(100) - lost)


def risk_level(score: Column, params: ScoringParams = DEFAULT_PARAMS) -> Column:
    return (
        F.when(score > F.lit(params.low), "Low")
        .when(score > F.lit(params.medium), "Medium")
        .otherwise("High")
    )


def recommendations(found: Column, risky: Column) -> Column:
    def advice(condition: Column, texts: list[str]) -> Column:
        return F.when(condition, strings(texts)).otherwise(strings([]))

    given = F.concat(
        advice(F.array_contains(found, "advertising"), ADVERTISING_ADVICE),
        advice(F.array_contains(found, "social_media"), SOCIAL_ADVICE),
        advice(F.size(risky) > 0, HIGH_RISK_ADVICE),
        advice(F.array_contains(found, "analytics"), ANALYTICS_ADVICE),
    )
    return F.when(F.size(given) > 0, given).otherwise(strings(DEFAULT_ADVICE))
