"""Rollups that grow by batches: partial totals per batch, merged when they are read.

A batch of scans is read once, when it comes. What is kept of it are sums and mergeable sketches by
day and risk label, so reports over any range of days read a few rows per batch and no scans. A
batch that is written again under its number replaces its own rows, and counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackscan.functions.text import ratio
from trackscan.plans.reports import metrics
from trackscan.sources import folders

#: Sketches have 2 ** LG_K registers at most; the standard error is about 0.8 / sqrt(2 ** LG_K).
LG_K = 14

_SUMS = ("scans", "trackers", "score_sum")
_SKETCHES = ("urls", "domains")


def daily_parts(scanned: DataFrame) -> DataFrame:
    """Totals of fetched pages by (scan_date, risk_level), with sketches of urls and domains.

    A page emits a row with its numbers and a row per domain; sums and sketches are combined
    before the shuffle, so a day with most of the pages is one row per task by then.
    """
    none = F.lit(None)
    own = F.struct(
        F.col("url").alias("url"),
        none.cast("string").alias("domain"),
        F.lit(1).cast("long").alias("scans"),
        F.col("summary.total_trackers").cast("long").alias("trackers"),
        F.col("privacy_analysis.privacy_score").cast("long").alias("score_sum"),
    )
    each = F.transform(
        F.coalesce("summary.domains_found", F.array().cast("array<string>")),
        lambda d: F.struct(
            none.cast("string").alias("url"),
            d.alias("domain"),
            *[none.cast("long").alias(n) for n in _SUMS],
        ),
    )
    rows = scanned.filter(F.col("error").isNull()).select(
        F.to_date("scan_timestamp").alias("scan_date"),
        F.col("privacy_analysis.risk_level").alias("risk_level"),
        F.inline(F.concat(F.array(own), each)),
    )
    return rows.groupBy("scan_date", "risk_level").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in _SUMS],
        F.hll_sketch_agg("url", LG_K).alias("urls"),
        F.hll_sketch_agg("domain", LG_K).alias("domains"),
    )


def merge_daily(parts: DataFrame) -> DataFrame:
    """One row per (scan_date, risk_level) out of those of many batches."""
    return parts.groupBy("scan_date", "risk_level").agg(
        *[F.sum(n).alias(n) for n in _SUMS], *[F.hll_union_agg(n).alias(n) for n in _SKETCHES]
    )


def metric_parts(scans: DataFrame, *edges: Sequence[float]) -> DataFrame:
    """Counters and histogram entries of a batch, as `reports.metrics` has them."""
    return metrics(scans, *edges)


def merge_metrics(parts: DataFrame) -> DataFrame:
    return parts.groupBy("metric", "le").agg(F.sum("value").alias("value"))


def _complete(spark: SparkSession, path: str, kind: str) -> list[int]:
    found = [n for n in folders.names(spark, path) if n.startswith(f"{kind}=")]
    whole = [n for n in found if "_SUCCESS" in folders.names(spark, f"{path}/{n}")]
    return sorted(int(n.split("=")[1]) for n in whole)


def write_batch(parts: DataFrame, path: str, batch: int) -> bool:
    """Store the rows of a batch; False, and nothing written, if `compact` has taken it in.

    Numbers are at least 0. A run that stops leaves a folder that is not read, until the batch runs
    again.
    """
    bases = _complete(parts.sparkSession, path, "base")
    if bases and batch <= bases[-1]:
        return False
    parts.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return True


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest base and of all complete batches after it; each batch counts once."""
    bases = _complete(spark, path, "base")[-1:]
    after = [b for b in _complete(spark, path, "batch") if not bases or b > bases[0]]
    read = [f"{path}/base={b}" for b in bases] + [f"{path}/batch={b}" for b in after]
    if not read:
        raise FileNotFoundError(f"no complete batch below {path}")
    return spark.read.parquet(*read)


def compact(spark: SparkSession, path: str, upto: int, merge=merge_daily) -> None:
    """Merge the batches up to a number, of which none may still be running, into one base.

    Readers see either the batches or the base, as a base counts once it is complete, and then
    stands for all numbers up to its own. A run that stops leaves folders that are not read and
    that the next one removes.
    """
    bases, batches = _complete(spark, path, "base"), _complete(spark, path, "batch")
    first = bases[-1] if bases else -1
    numbers = [int(n.split("=")[1]) for n in folders.names(spark, path) if n.startswith("batch=")]
    if broken := [n for n in numbers if first < n <= upto and n not in batches]:
        raise ValueError(f"batches {broken} are not complete")
    taken = [b for b in batches if first < b <= upto]
    if taken:
        read = [f"{path}/base={b}" for b in bases[-1:]] + [f"{path}/batch={b}" for b in taken]
        merge(spark.read.parquet(*read)).write.mode("overwrite").parquet(f"{path}/base={upto}")
        first = upto
    for name in folders.names(spark, path):
        kind, _, number = name.partition("=")
        if (kind == "base" and int(number) != first) or (kind == "batch" and int(number) <= first):
            folders.remove(spark, f"{path}/{name}")


def _distinct(sketch: str) -> Column:
    return F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias(sketch)


def per_period(parts: DataFrame, unit: str = "week") -> DataFrame:
    """Totals per week (or month, quarter, year) from the daily rows; distinct counts are estimates."""

    def pages(level: str) -> Column:
        own = F.when(F.col("risk_level") == level, F.col("scans"))
        return F.coalesce(F.sum(own), F.lit(0)).alias(level.lower())

    period = F.to_date(F.date_trunc(unit, "scan_date")).alias(unit)
    return parts.groupBy(period).agg(
        F.sum("scans").alias("pages"),
        F.sum("trackers").alias("trackers"),
        ratio(F.sum("score_sum"), F.sum("scans")).alias("mean_score"),
        *[pages(level) for level in ("Low", "Medium", "High")],
        *[_distinct(s) for s in _SKETCHES],
    )


def statistics(parts: DataFrame) -> DataFrame:
    """What `reports.api_statistics` gives for the scans of all batches, exactly."""
    rows = parts.select(
        "risk_level", F.date_format("scan_date", "yyyy-MM-dd").alias("day"), *_SUMS
    )
    total = [F.coalesce(F.sum(n), F.lit(0)) for n in _SUMS]
    return (
        rows.groupingSets([[], ["risk_level"], ["day"]], "risk_level", "day")
        .agg(
            total[0].alias("scans"),
            total[1].alias("trackers"),
            ratio(total[2], total[0]).alias("mean_score"),
            F.grouping_id().alias("_set"),
        )
        .select(
            F.when(F.col("_set") == 3, "total")
            .when(F.col("_set") == 1, "risk_level")
            .otherwise("day")
            .alias("statistic"),
            F.coalesce("risk_level", "day", F.lit("")).alias("value"),
            "scans",
            "trackers",
            "mean_score",
        )
    )
