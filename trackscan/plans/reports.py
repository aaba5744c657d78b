"""Reports over scan results.

They read result rows, never page text: scan once, write the results, report from the table,
and only the named columns of it are read. Each report is one pass: rows that feed different
totals are emitted side by side and aggregated together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.functions.match import strings
from trackscan.functions.text import ratio


def _exploded(rows: DataFrame, array: str, name: str, *keys: Column) -> DataFrame:
    """One row per entry, without the emptiness test that would compute the array twice."""
    return rows.select(*keys, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def page_counts(scanned: DataFrame) -> DataFrame:
    return scanned.select(
        "page_id",
        "pixel_count",
        "js_tracker_count",
        "meta_tracker_count",
        "css_tracker_count",
        F.col("summary.total_trackers").alias("total_trackers"),
    )


def _tally(rows: DataFrame, keys: list[str], domains: Column, **numbers: Column) -> DataFrame:
    """Per key: sums of whole per-page numbers and the number of distinct domains, in one pass.

    Every page gives one row without a domain that carries its numbers, and one row per
    domain. The first step counts them by key and domain with a map-side combine, so the
    second sees at most one row per domain whatever the number of pages.
    """
    names = list(numbers)
    own = F.struct(
        F.lit(None).cast("string").alias("domain"),
        *[numbers[n].cast("long").alias(n) for n in names],
    )
    each = F.transform(
        domains,
        lambda d: F.struct(d.alias("domain"), *[F.lit(None).cast("long").alias(n) for n in names]),
    )
    none = F.filter(F.array(own), lambda r: F.lit(False))
    emitted = rows.select(*keys, F.inline(F.concat(F.array(own), F.coalesce(each, none))))
    by_domain = emitted.groupBy(*keys, "domain").agg(*[F.sum(n).alias(n) for n in names])
    return by_domain.groupBy(*keys).agg(
        F.count("domain").alias("domains"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
    )


def batch_totals(scanned: DataFrame) -> DataFrame:
    """Totals of a batch; failed pages count as sites without trackers."""
    tally = _tally(
        scanned,
        [],
        F.col("summary.domains_found"),
        pages=F.lit(1),
        trackers=F.coalesce("summary.total_trackers", F.lit(0)),
    )
    return tally.select(
        F.col("pages").cast("long").alias("total_sites_scanned"),
        F.col("trackers").cast("long").alias("total_trackers_found"),
        F.col("domains").alias("unique_tracking_domains"),
        ratio(F.col("trackers"), F.col("pages")).alias("average_trackers_per_site"),
    )


def tally_by(scanned: DataFrame, *keys: str) -> DataFrame:
    """Fetched pages, trackers, domains, mean score and pages per risk label, by key."""
    risk = F.col("privacy_analysis.risk_level")
    tally = _tally(
        scanned.filter(F.col("error").isNull()),
        list(keys),
        F.col("summary.domains_found"),
        pages=F.lit(1),
        trackers=F.col("summary.total_trackers"),
        score=F.col("privacy_analysis.privacy_score"),
        low=(risk == "Low").cast("int"),
        medium=(risk == "Medium").cast("int"),
        high=(risk == "High").cast("int"),
    )
    whole = [F.col(n).cast("long").alias(n) for n in ("pages", "trackers", "low", "medium", "high")]
    return tally.select(
        *keys, *whole, "domains", ratio(F.col("score"), F.col("pages")).alias("mean_score")
    )


def domain_pages(scanned: DataFrame) -> DataFrame:
    """Pages per found domain; each page lists a domain once."""
    return (
        _exploded(scanned, "summary.domains_found", "domain")
        .groupBy("domain")
        .agg(F.count("*").alias("pages"))
    )


def top_domains(scanned: DataFrame, k: int = 10) -> DataFrame:
    return domain_pages(scanned).orderBy(F.desc("pages"), "domain").limit(k)


def distinct_domains(scanned: DataFrame) -> DataFrame:
    return _exploded(scanned, "summary.domains_found", "domain").distinct()


def intelligence_summary(enhanced: DataFrame) -> DataFrame:
    """Totals of an enhanced batch."""
    tally = _tally(
        enhanced,
        [],
        F.col("risk_assessment.third_party_domains"),
        pages=F.lit(1),
        trackers=F.col("tracker_count"),
        score=F.col("privacy_score"),
    )
    return tally.select(
        F.col("pages").cast("long").alias("total_urls"),
        F.col("trackers").cast("long").alias("total_trackers"),
        ratio(F.col("score"), F.col("pages")).alias("average_privacy_score"),
        F.col("domains").alias("unique_tracking_domains"),
    )


def top_categories(enhanced: DataFrame, k: int = 10) -> DataFrame:
    return (
        _exploded(enhanced, "trackers.category", "category")
        .groupBy("category")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "category")
        .limit(k)
    )


def most_tracked_domains(enhanced: DataFrame, k: int = 20) -> DataFrame:
    return (
        _exploded(enhanced, "risk_assessment.third_party_domains", "domain")
        .groupBy("domain")
        .agg(F.count("*").alias("pages"))
        .orderBy(F.desc("pages"), "domain")
        .limit(k)
    )


def common_trackers(detected: DataFrame, k: int = 10) -> DataFrame:
    """Catalogue trackers by the number of pages that carry them."""
    return (
        detected.groupBy("tracker_id", "name")
        .agg(F.count("*").alias("pages"))
        .orderBy(F.desc("pages"), "tracker_id")
        .limit(k)
    )


def api_statistics(scanned: DataFrame) -> DataFrame:
    """Totals, risk distribution and daily counts as (statistic, value, scans, trackers, mean)."""
    day = F.date_format("scan_timestamp", "yyyy-MM-dd")
    rows = scanned.filter(F.col("error").isNull()).select(
        F.col("privacy_analysis.risk_level").alias("risk_level"),
        day.alias("day"),
        F.col("summary.total_trackers").alias("trackers"),
        F.col("privacy_analysis.privacy_score").alias("score"),
    )
    return (
        rows.groupingSets([[], ["risk_level"], ["day"]], "risk_level", "day")
        .agg(
            F.count("*").alias("scans"),
            F.coalesce(F.sum("trackers"), F.lit(0)).alias("trackers"),
            F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
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


def bucket(value: Column, edges: Sequence[float]) -> Column:
    """Upper edge of the bucket a value falls into; above the last edge it is infinite."""
    chain = F
    for edge in sorted(edges):
        chain = chain.when(value <= F.lit(float(edge)), F.lit(float(edge)))
    return chain.otherwise(F.lit(float("inf")))


def metrics(
    scans: DataFrame,
    score_edges: Sequence[float] = (10, 20, 30, 40, 50, 60, 70, 80, 90, 100),
    duration_edges: Sequence[float] = (0.1, 0.5, 1, 2.5, 5, 10, 30, 60),
) -> DataFrame:
    """Counters and histograms of scans (tracker_count, privacy_score, scan_duration).

    One row per (metric, upper edge); counters have no edge.
    """
    none = F.lit(None).cast("double")

    def row(metric: str, le: Column, amount: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), le.alias("le"), amount.cast("long").alias("amount")
        )

    rows = F.array(
        row("scans_total", none, F.lit(1)),
        row("trackers_detected_total", none, F.col("tracker_count")),
        row("scan_duration_seconds", bucket(F.col("scan_duration"), duration_edges), F.lit(1)),
        row("privacy_score_histogram", bucket(F.col("privacy_score"), score_edges), F.lit(1)),
    )
    return (
        scans.select(F.inline(rows)).groupBy("metric", "le").agg(F.sum("amount").alias("value"))
    )


def score_distribution(scanned: DataFrame, buckets: int = 10) -> DataFrame:
    """Pages per score range; the full score is in the last range."""
    score = F.col("privacy_analysis.privacy_score")
    number = F.least(F.width_bucket(score, F.lit(0), F.lit(100), F.lit(buckets)), F.lit(buckets))
    return (
        scanned.filter(F.col("error").isNull())
        .groupBy(number.cast("long").alias("bucket"))
        .agg(F.count("*").alias("pages"))
    )


def domain_activity(scanned: DataFrame) -> DataFrame:
    """Pages per domain and day, in long form."""
    day = F.date_format("scan_timestamp", "yyyy-MM-dd").alias("day")
    return (
        _exploded(scanned, "summary.domains_found", "domain", day)
        .groupBy("domain", "day")
        .agg(F.count("*").alias("pages"))
    )


OTHER_DAYS = "other_days"


def heatmap(scanned: DataFrame, days: Sequence[str]) -> DataFrame:
    """Domain by day; the days are given, so no extra pass looks for them.

    Pages of all other days, and of no day, are in the column other_days.
    """
    day = F.when(F.col("day").isin(*days), F.col("day")).otherwise(OTHER_DAYS)
    return (
        domain_activity(scanned)
        .withColumn("day", day)
        .groupBy("domain")
        .pivot("day", [*days, OTHER_DAYS])
        .sum("pages")
        .na.fill(0)
    )


def report_rows(scanned: DataFrame) -> DataFrame:
    """What a page report shows: counts, score, domains marked when high risk, advice."""
    risky = F.col("privacy_analysis.high_risk_domains")
    marked = F.transform(
        "summary.domains_found",
        lambda d: F.struct(
            d.alias("domain"), F.coalesce(F.array_contains(risky, d), F.lit(False)).alias("high_risk")
        ),
    )
    pixels = F.transform(
        "tracking_pixels",
        lambda p: F.struct(
            p["element_type"].alias("element_type"),
            F.concat(F.substring(p["src"], 1, 100), F.lit("...")).alias("source"),
            p["tracking_domain"].alias("domain"),
            F.coalesce(p["is_1x1_pixel"], F.lit(False)).alias("one_pixel"),
        ),
    )
    return scanned.select(
        "page_id",
        "url",
        "error",
        "pixel_count",
        "js_tracker_count",
        "meta_tracker_count",
        "css_tracker_count",
        F.col("summary.total_trackers").alias("total_trackers"),
        F.col("privacy_analysis.privacy_score").alias("privacy_score"),
        F.col("privacy_analysis.risk_level").alias("risk_level"),
        F.array_join("privacy_analysis.detected_categories", ", ").alias("categories"),
        marked.alias("domains"),
        F.when(F.col("error").isNull(), pixels).alias("pixels"),
        F.coalesce("privacy_analysis.recommendations", strings([])).alias("recommendations"),
    )


def by_risk(rows: DataFrame, level: str, column: str = "risk_level") -> DataFrame:
    return rows.filter(F.col(column) == level)


def paged(results: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of results, newest first, ties by page number."""
    return results.orderBy(F.desc("scan_timestamp"), "page_id").offset(offset).limit(limit)


def seek(results: DataFrame, limit: int = 50, after: tuple | None = None) -> DataFrame:
    """The same pages of results by the place where the last one ended.

    after is (scan_timestamp, page_id) of the last row that was shown. Only limit rows of each task
    meet, however far the page is, and a table that is stored by time skips the files before it.
    """
    if after is not None:
        time, page = F.lit(after[0]), F.lit(after[1])
        same = (F.col("scan_timestamp") == time) & (F.col("page_id") > page)
        results = results.filter((F.col("scan_timestamp") <= time) & ((F.col("scan_timestamp") < time) | same))
    return results.orderBy(F.desc("scan_timestamp"), "page_id").limit(limit)


def first_per_page(scanned: DataFrame, array: str, n: int) -> DataFrame:
    """The first n entries of an array column of each page."""
    return scanned.select("page_id", F.slice(array, 1, n).alias("first"))
