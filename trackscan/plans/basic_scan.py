"""The basic scan: one page row in, one result row out, with no exchange.

Everything a page needs is in its own row, so the scan is a chain of narrow projections; it
runs the same on a stream and on a batch, and the page text never enters a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.fixed_values import SCRIPT_PATTERNS, TRACKER_DOMAINS
from trackscan.functions.lex import scan_elements
from trackscan.operators import scoring
from trackscan.operators.css import styles
from trackscan.operators.meta import metas
from trackscan.operators.pixels import pixels
from trackscan.operators.scripts import scripts
from trackscan.params import DEFAULT_PARAMS, ScoringParams

# Fixed value: the error text of a page without content.
FETCH_ERROR = "Failed to fetch page content"

# Detection arrays, each with a field that every entry has.
DETECTIONS = {
    "tracking_pixels": "element_type",
    "javascript_trackers": "type",
    "meta_trackers": "type",
    "css_trackers": "type",
}

Step = Callable[[DataFrame], DataFrame]


def extract_elements(pages: DataFrame) -> DataFrame:
    """Default parser: replaces the page text by its elements and an error column.

    A filter on a result column would otherwise be pushed below the projections and take the
    lexer with it, once per mention. Filters do not pass a generator, so the elements come
    out of one that makes a single row.
    """
    kept = [c for c in pages.columns if c != "html"]
    failed = F.coalesce(F.length("html"), F.lit(0)) == 0
    elements = F.when(~failed, scan_elements(F.col("html")))
    return pages.select(*kept, "html", F.when(failed, FETCH_ERROR).alias("error")).select(
        *kept, "error", F.explode(F.array(elements)).alias("elements")
    )


def detect(
    pages: DataFrame,
    domains: Sequence[str] = TRACKER_DOMAINS,
    patterns: Sequence[str] = SCRIPT_PATTERNS,
    with_source: bool = True,
) -> DataFrame:
    """Replaces the elements by the four detection arrays and the bag of found domains."""
    elements = F.col("elements")
    kept = [c for c in pages.columns if c != "elements"]
    found = pages.select(
        *kept,
        pixels(elements, domains, with_source).alias("tracking_pixels"),
        scripts(elements, domains, patterns, with_source).alias("javascript_trackers"),
        metas(elements, with_source).alias("meta_trackers"),
        styles(elements, domains, with_source).alias("css_trackers"),
    )
    return found.withColumn("domains", domain_bag())


def domain_bag() -> Column:
    """Domains of pixels, scripts and styles, repeated as often as they were found."""
    return F.array_compact(
        F.concat(
            F.transform("tracking_pixels", lambda p: p["tracking_domain"]),
            F.transform("javascript_trackers", lambda s: s["domain"]),
            F.transform("css_trackers", lambda c: c["domain"]),
        )
    )


def score_pages(detected: DataFrame, params: ScoringParams = DEFAULT_PARAMS) -> DataFrame:
    """Default analyser: adds the `privacy_analysis` struct."""
    staged = detected.select(
        "*",
        scoring.categories(F.col("domains")).alias("_found"),
        scoring.high_risk(F.col("domains")).alias("_risky"),
    )
    value = scoring.score_value(
        F.size("tracking_pixels"),
        scoring.count_scripts(F.col("javascript_trackers"), "external_script"),
        scoring.count_scripts(F.col("javascript_trackers"), "inline_script"),
        F.size("_risky"),
        params,
    )
    whole = all(isinstance(v, int) for v in vars(params).values())
    scored = staged.withColumn("_score", value.cast("int") if whole else value)
    analysis = F.struct(
        F.col("_score").alias("privacy_score"),
        scoring.risk_level(F.col("_score"), params).alias("risk_level"),
        F.col("_found").alias("detected_categories"),
        F.col("_risky").alias("high_risk_domains"),
        scoring.recommendations(F.col("_found"), F.col("_risky")).alias("recommendations"),
    )
    good = F.col("error").isNull()
    return scored.withColumn("privacy_analysis", F.when(good, analysis)).drop(
        "_found", "_risky", "_score"
    )


def summarise(scored: DataFrame) -> DataFrame:
    """Counts per family and the distinct domains; all null for a failed page."""
    good = F.col("error").isNull()
    pixel, script, meta, css = (F.when(good, F.size(name)) for name in DETECTIONS)
    summary = F.struct(
        (pixel + script + meta + css).alias("total_trackers"),
        F.array_sort(F.array_distinct("domains")).alias("domains_found"),
        F.struct(
            pixel.alias("pixels"),
            script.alias("javascript"),
            meta.alias("meta_tags"),
            css.alias("css_background"),
        ).alias("tracking_types"),
    )
    return scored.select(
        "*",
        pixel.alias("pixel_count"),
        script.alias("js_tracker_count"),
        meta.alias("meta_tracker_count"),
        css.alias("css_tracker_count"),
        F.when(good, summary).alias("summary"),
    )


def scan(
    pages: DataFrame,
    *,
    params: ScoringParams = DEFAULT_PARAMS,
    domains: Sequence[str] = TRACKER_DOMAINS,
    patterns: Sequence[str] = SCRIPT_PATTERNS,
    custom_patterns: Sequence[str] = (),
    scan_ts: Column | None = None,
    extract: Step = extract_elements,
    score: Step | None = None,
    with_source: bool = True,
) -> DataFrame:
    """Scan pages (page_id, url, html, ...) into one result row per page.

    `extract` replaces the parser and `score` the analyser; both map a DataFrame to one.
    `with_source=False` leaves the element texts out of the detection rows.
    """
    analyse = score or (lambda detected: score_pages(detected, params))
    stamp = F.current_timestamp() if scan_ts is None else scan_ts
    return (
        pages.transform(extract)
        .transform(
            lambda df: detect(df, domains, [*patterns, *custom_patterns], with_source)
        )
        .transform(analyse)
        .transform(summarise)
        .withColumn("scan_timestamp", stamp)
    )


def detections(scanned: DataFrame, array: str, *keys: str) -> DataFrame:
    """One row per entry of a detection array, with the key columns (the page by default).

    The plain generator would make Spark test the array for entries below the projections,
    which computes it twice; the outer one does not, and its empty rows are dropped here.
    """
    rows = scanned.select(*(keys or ("page_id",)), F.inline_outer(array))
    return rows.filter(F.col(DETECTIONS[array]).isNotNull())
