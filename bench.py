"""Headline queries at one scale factor; prints one JSON line.

Reads BENCH_SF_DIR and BENCH_CPUS. Every query runs once unmeasured, so that the figures are
not those of a cold JVM, and then three times; the median counts. Rows go to a sink that
computes all columns and keeps none.
"""

from __future__ import annotations

import functools
import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import query_set as q  # noqa: E402
from trackscan import scan  # noqa: E402
from trackscan.plans import reports, trends  # noqa: E402
from trackscan.streaming.streams import shared_folder  # noqa: E402

RUNS = 3
COPIES = 10


def copied(spark: SparkSession, sf: str):
    """The basic scan over COPIES times the pages; the plan is built once for all of them."""
    pages = q.pages_of(spark, sf)
    times = F.explode(F.sequence(F.lit(1), F.lit(COPIES)))
    return scan(pages.withColumn("copy", times).drop("copy"), with_source=True)


def reports_from_table(spark: SparkSession, sf: str):
    """Scan once into a table, and make four reports from it."""
    path = shared_folder(spark, "bench-results")
    q.scanned(spark, sf).write.parquet(path)
    results = spark.read.parquet(path)
    made = (
        reports.batch_totals(results),
        reports.top_domains(results, 20),
        reports.score_distribution(results),
        trends.weekly(results),
    )
    rows = [df.select(F.to_json(F.struct("*")).alias("row")) for df in made]
    return functools.reduce(lambda a, b: a.union(b), rows)


HEADLINE = {
    "basic_scan_full": lambda spark, sf: q.scanned(spark, sf, with_source=True),
    "privacy_scores": q.QUERIES["privacy_scores"],
    "tracking_pixels": q.QUERIES["tracking_pixels"],
    "inline_scripts": q.QUERIES["inline_scripts"],
    "element_counts": q.QUERIES["element_counts"],
    "enhanced_scores": q.QUERIES["enhanced_scores"],
    "catalogue_detections": q.QUERIES["catalogue_detections"],
    "tracking_parameters": q.QUERIES["tracking_parameters"],
    "batch_totals": q.QUERIES["batch_totals"],
    "top_domains": q.QUERIES["top_domains"],
    "weekly_summary": q.QUERIES["weekly_summary"],
    "security_headers": q.QUERIES["security_headers"],
    "change_alerts": q.QUERIES["change_alerts"],
    "metric_anomalies": q.QUERIES["metric_anomalies"],
    "stream_scan": q.QUERIES["stream_scan"],
    "basic_scan_copied": copied,
    "reports_from_table": reports_from_table,
}


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trackscan-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    pages = spark.read.parquet(f"{sf}/pages.parquet").count()
    times = {}
    for name, fn in HEADLINE.items():
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf).name.removeprefix("sf"),
                "cpus": int(cpus),
                "pages": pages,
                "pages_per_second": round(pages / times["basic_scan_full"]),
                "pages_per_second_copied": round(COPIES * pages / times["basic_scan_copied"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
