"""Scan history: rows, append sink, time filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackscan.functions.text import fingerprint
from trackscan.sources import folders

HISTORY_SCHEMA = (
    "url string, scan_ts timestamp, tracker_count int, privacy_score int, result_hash string,"
    " scan_date date"
)


def history_rows(scanned: DataFrame) -> DataFrame:
    """One history row per fetched page. The hash covers the outcome, not the time."""
    good = scanned.filter(F.col("error").isNull())
    return good.select(
        "url",
        F.col("scan_timestamp").alias("scan_ts"),
        F.col("summary.total_trackers").alias("tracker_count"),
        F.col("privacy_analysis.privacy_score").alias("privacy_score"),
        fingerprint(
            "pixel_count",
            "js_tracker_count",
            "meta_tracker_count",
            "css_tracker_count",
            F.col("privacy_analysis.privacy_score").alias("privacy_score"),
            F.col("summary.domains_found").alias("domains_found"),
            F.array_sort("privacy_analysis.high_risk_domains").alias("high_risk_domains"),
        ).alias("result_hash"),
        F.to_date("scan_timestamp").alias("scan_date"),
    )


def append(history: DataFrame, path: str, files_per_day: int = 32) -> None:
    """Append to the history table, split by date.

    Rows of one date go to a fixed number of writers, so neither does a busy date or url end
    in one task nor a back-fill in one file per task and date.
    """
    share = F.pmod(F.xxhash64("url", "scan_ts"), F.lit(files_per_day))
    history.repartition("scan_date", share).write.mode("append").partitionBy(
        "scan_date"
    ).parquet(path)


#: The column of a bucketed table that parts each url's scans by time.
PART = "scan_part"


def append_bucketed(
    history: DataFrame, table: str, path: str, unit: str = "hour", buckets: int = 256
) -> None:
    """Append to a catalogue table that is bucketed by url and a span of time, and sorted by time.

    Rows of one url and span are in one bucket, so `trends.previous(part=PART)` shuffles no rows; a
    url with a third of the scans is in as many buckets as it has spans. The span depends on the
    time alone, so that later appends agree with earlier ones; take the unit so that a span of the
    busiest url suits one task. An append is dealt out by bucket first and makes one file for each.
    """
    parted = history.withColumn(PART, F.date_trunc(unit, "scan_ts"))
    (
        parted.repartition(buckets, "url", PART)
        .write.mode("append")
        .format("parquet")
        .bucketBy(buckets, "url", PART)
        .sortBy("url", "scan_ts")
        .option("path", path)
        .saveAsTable(table)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(path)


def last_days(history: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Scans of the last days; the date bound prunes table partitions."""
    since = as_of - F.make_interval(days=F.lit(days))
    return history.filter(
        (F.col("scan_date") >= F.to_date(since)) & (F.col("scan_ts") >= since)
    )


def retained(history: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """History without the dates that are past retention; reads whole partitions only."""
    return history.filter(F.col("scan_date") >= F.date_sub(F.to_date(as_of), days))


def expire(spark: SparkSession, path: str, as_of: dt.datetime, days: int = 30) -> list[str]:
    """Remove what is older than some days from the history table; returns the dates that went.

    The date that is kept in part is written anew first, from a copy of its kept rows beside the
    table, then the folders of older dates go, the oldest first. A run that stops in between
    leaves a table without holes: the copy replaces the date if its folder was lost, and the rest
    is done by the next run. Rows without a date stay.
    """
    since = as_of - dt.timedelta(days=days)
    copies, edge = f"{path}/_expiring", f"scan_date={since.date()}"
    for name in folders.names(spark, copies):
        complete = "_SUCCESS" in folders.names(spark, f"{copies}/{name}")
        if complete and name not in folders.names(spark, path):
            _write_date(spark, f"{copies}/{name}", path)
        folders.remove(spark, f"{copies}/{name}")
    dates = [n for n in folders.names(spark, path) if n.startswith("scan_date=2") or n.startswith("scan_date=1")]
    if edge in dates:
        rows = read(spark, path).filter(F.col("scan_date") == F.lit(since.date()))
        kept = rows.filter(F.col("scan_ts") >= F.lit(since))
        if rows.filter(F.col("scan_ts") < F.lit(since)).limit(1).count():
            kept.write.mode("overwrite").parquet(f"{copies}/{edge}")
            if kept.limit(1).count():
                _write_date(spark, f"{copies}/{edge}", path)
            else:
                folders.remove(spark, f"{path}/{edge}")
            folders.remove(spark, f"{copies}/{edge}")
    old = [n for n in dates if n < edge]
    for name in old:
        folders.remove(spark, f"{path}/{name}")
    return [n.split("=")[1] for n in old]


def _write_date(spark: SparkSession, copy: str, path: str) -> None:
    """Replace one date of the table by a copy of it; the other dates stay."""
    read(spark, copy).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "scan_date"
    ).parquet(path)


def level_alerts(
    history: DataFrame, min_privacy_score: int = 60, max_trackers: int = 50
) -> DataFrame:
    """Scans with a score below, or a tracker count above, the limits."""
    low = F.col("privacy_score") < min_privacy_score
    many = F.col("tracker_count") > max_trackers
    reasons = F.array_compact(
        F.array(F.when(low, "low_privacy_score"), F.when(many, "too_many_trackers"))
    )
    return history.filter(low | many).withColumn("reasons", reasons)
