"""The enhanced scan: exact hosts and fingerprinting, per page and with no exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.fixed_values import HOST_INTELLIGENCE
from trackscan.functions.lex import scan_elements
from trackscan.functions.match import strings
from trackscan.operators.intel import (
    fingerprint_hits,
    fingerprint_trackers,
    host_trackers,
)

# Points per risk level and per category. There are none for critical.
RISK_POINTS = {"high": 15, "medium": 8, "low": 3}
CATEGORY_POINTS = {"advertising": 10, "social_advertising": 10, "privacy_invasion": 20}


def _points(value: Column, table: dict[str, int]) -> Column:
    chain = F
    for key, points in table.items():
        chain = chain.when(value == key, F.lit(points))
    return chain.otherwise(F.lit(0))


def enhanced_score(trackers: Column) -> Column:
    lost = F.aggregate(
        trackers,
        F.lit(0),
        lambda acc, t: acc
        + _points(t["risk_level"], RISK_POINTS)
        + _points(t["category"], CATEGORY_POINTS),
    )
    return F.greatest(F.lit(0), F.lit(100) - lost)


def _distinct(trackers: Column, field: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(trackers, lambda t: t[field])))


def risk_assessment(trackers: Column) -> Column:
    def count(level: str) -> Column:
        return F.size(F.filter(trackers, lambda t: t["risk_level"] == level))

    def any_category(category: str) -> Column:
        return F.exists(trackers, lambda t: t["category"] == category)

    overall = (
        F.when((count("high") > 3) | any_category("privacy_invasion"), "high")
        .when((count("high") > 0) | (count("medium") > 5), "medium")
        .otherwise("low")
    )
    collection = F.array_compact(
        F.array(
            F.when(any_category("advertising"), "behavioral_profiling"),
            F.when(any_category("analytics"), "usage_analytics"),
        )
    )
    return F.struct(
        overall.alias("overall_risk"),
        strings([]).alias("specific_risks"),
        collection.alias("data_collection"),
        _distinct(trackers, "domain").alias("third_party_domains"),
        _distinct(trackers, "tracker_type").alias("tracking_methods"),
    )


def enhanced_scan(
    pages: DataFrame,
    *,
    intel: Sequence[tuple] = HOST_INTELLIGENCE,
    scan_ts: Column | None = None,
) -> DataFrame:
    """Scan pages (page_id, url, html, optional metrics) into one result row per page.

    A page that failed to load is a page without text: no trackers, full score, and the error
    inside its metrics.
    """
    stamp = F.current_timestamp() if scan_ts is None else scan_ts
    kept = [c for c in pages.columns if c != "html"]
    html = F.coalesce("html", F.lit(""))
    staged = pages.select(
        *kept,
        fingerprint_hits(html).alias("_hits"),
        scan_elements(html).alias("_elements"),
        stamp.alias("timestamp"),
    )
    trackers = F.concat(
        host_trackers(F.col("_elements"), F.col("timestamp"), intel),
        fingerprint_trackers(F.col("_hits"), F.col("url"), F.col("timestamp")),
    )
    # Out of a generator, so that filters on results do not copy the detection below it.
    found = staged.select(*kept, "timestamp", F.explode(F.array(trackers)).alias("trackers"))
    return found.select(
        "*",
        F.size("trackers").alias("tracker_count"),
        enhanced_score(F.col("trackers")).alias("privacy_score"),
        risk_assessment(F.col("trackers")).alias("risk_assessment"),
    )
