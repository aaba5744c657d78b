"""The fixed lists as small DataFrames.

Each is one constant in the plan, so Spark knows how small it is and broadcasts it in joins.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackscan import fixed_values as fixed

CATALOGUE_SCHEMA = (
    "tracker_id string, ord int, name string, category string, risk_level string,"
    " patterns array<string>, domains array<string>, description string,"
    " data_types array<string>, gdpr_relevant boolean, ccpa_relevant boolean,"
    " detection_method string, evasion_techniques array<string>, first_seen date"
)


def constant_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table from a handful of rows that are part of the program."""
    text = F.lit(json.dumps(rows, default=str))
    return spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))


def tracker_domains(spark: SparkSession) -> DataFrame:
    rows = [{"ord": i, "domain": d} for i, d in enumerate(fixed.TRACKER_DOMAINS)]
    return constant_table(spark, rows, "ord int, domain string")


def first_domains(spark: SparkSession, n: int = 10) -> DataFrame:
    return tracker_domains(spark).orderBy("ord").limit(n)


def script_patterns(spark: SparkSession) -> DataFrame:
    rows = [{"ord": i, "pattern": p} for i, p in enumerate(fixed.SCRIPT_PATTERNS)]
    return constant_table(spark, rows, "ord int, pattern string")


def category_domains(spark: SparkSession) -> DataFrame:
    rows = [
        {"category": c, "domain": d}
        for c, domains in fixed.CATEGORY_DOMAINS.items()
        for d in domains
    ]
    return constant_table(spark, rows, "category string, domain string")


def verification_meta(spark: SparkSession) -> DataFrame:
    return constant_table(spark, [{"name": n} for n in fixed.VERIFICATION_META], "name string")


def host_intelligence(spark: SparkSession) -> DataFrame:
    names = ("domain", "category", "risk", "purpose")
    rows = [dict(zip(names, row)) for row in fixed.HOST_INTELLIGENCE]
    return constant_table(spark, rows, ", ".join(f"{n} string" for n in names))


def pattern_families(spark: SparkSession) -> DataFrame:
    rows = [
        {"family": family, "ord": i, "pattern": pattern}
        for family, patterns in fixed.PATTERN_FAMILIES.items()
        for i, pattern in enumerate(patterns)
    ]
    return constant_table(spark, rows, "family string, ord int, pattern string")


def catalogue(
    spark: SparkSession,
    trackers: Sequence[tuple] = fixed.CATALOGUE,
    last_updated: str = "1970-01-01 00:00:00",
) -> DataFrame:
    """The tracker catalogue: one row per tracker, `ord` is its place in lookup order."""
    rows = [{**dict(zip(fixed.CATALOGUE_FIELDS, t)), "ord": i} for i, t in enumerate(trackers)]
    return constant_table(spark, rows, CATALOGUE_SCHEMA).withColumn(
        "last_updated", F.lit(last_updated).cast("timestamp")
    )
