"""The registered queries: each Spark function with the SQL it is checked against.

Every query reads whole tables: `pages` through the planted view, or `events`.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import duckdb_sql as sql
from checks.duckdb_sql import TS, cut, host, text, with_parts
from trackscan import fixed_values as fixed
from trackscan.functions import lex, urls
from trackscan.functions.text import dotted
from trackscan.operators import (
    anomaly,
    catalog,
    cluster,
    enrich,
    intel,
    requests,
    scoring,
    scripts,
    security,
)
from trackscan.params import ScoringParams
from trackscan.plans import basic_scan, reports, rollups, trends
from trackscan.plans.basic_scan import detections, scan
from trackscan.plans.enhanced_scan import enhanced_scan
from trackscan.sources import catalog_files, folders, history, results, seeds
from trackscan.sources.pages import METRICS, PAGE_WITH_METRICS_SCHEMA, failed, read_pages
from trackscan.sources.planted import SCAN_TS, web_pages
from trackscan.sources.requests import read_requests, requests_of_pages
from trackscan.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None, *parts: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            SQL[fn.__name__] = with_parts(oracle, *parts) if parts else oracle
        return fn

    return register


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def pages_of(spark: SparkSession, sf: str) -> DataFrame:
    return web_pages(read_pages(spark, f"{sf}/pages.parquet"))


def scanned(spark: SparkSession, sf: str, **options) -> DataFrame:
    options.setdefault("with_source", False)
    return scan(pages_of(spark, sf), scan_ts=F.expr(SCAN_TS), **options)


def enhanced(spark: SparkSession, sf: str) -> DataFrame:
    return enhanced_scan(pages_of(spark, sf), scan_ts=F.expr(SCAN_TS))


def detected(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.detect_in_pages(pages_of(spark, sf))


def seen_trackers(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue rows of the trackers found on the pages."""
    return seeds.catalogue(spark).join(
        detected(spark, sf).select("tracker_id").distinct(), "tracker_id", "left_semi"
    )


EVENT_HISTORY = {
    "url": "concat('https://site-', user_id, '.example/')",
    "scan_ts": "cast(ts as timestamp)",
    "tracker_count": "cast(get_json_object(props, '$.k') as int)",
    "privacy_score": "cast(greatest(0, 100 - cast(floor(value) as int)) as int)",
}


def history_of(events: DataFrame) -> DataFrame:
    """Scan history derived from the event table: a user is a site, an event a scan."""
    return events.select(
        "event_id", "event_type", *[F.expr(e).alias(n) for n, e in EVENT_HISTORY.items()]
    ).select(
        "*",
        F.sha2(F.concat_ws("|", "tracker_count", "privacy_score"), 256).alias("result_hash"),
        F.to_date("scan_ts").alias("scan_date"),
    )


def site_history(spark: SparkSession, sf: str) -> DataFrame:
    return history_of(load(spark, sf, "events"))


def long(column: str, name: str | None = None):
    return F.col(column).cast("long").alias(name or column.split(".")[-1])


def joined(column: str, name: str):
    return F.array_join(column, ",").alias(name)


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


# --- sources -------------------------------------------------------------------------------


@query(
    "SELECT page_id, url, 'Failed to fetch page content' AS error FROM web WHERE html = ''", "web"
)
def failed_pages(spark, sf):
    return failed(scanned(spark, sf))


def _with_metrics(pages: DataFrame) -> DataFrame:
    bad = F.length("html") == 0
    metrics = F.struct(
        (F.col("page_id") % 40 / 8).alias("response_time"),
        F.lit(200).alias("status_code"),
        F.length("html").cast("long").alias("content_length"),
        F.create_map(F.lit("Server"), F.concat(F.lit("s"), (F.col("page_id") % 3))).alias("headers"),
        F.lit(0).alias("redirects"),
        F.col("url").alias("final_url"),
        F.lit(None).cast("string").alias("error"),
    ).cast(METRICS)
    error = F.from_json(F.lit('{"error":"no response"}'), METRICS)
    return pages.withColumn("metrics", F.when(bad, error).otherwise(metrics))


@query(
    "SELECT server, error, count(*) AS pages, CAST(sum(n) AS BIGINT) AS chars, round(avg(t), 4) AS mean_time FROM"
    " (SELECT CASE WHEN html <> '' THEN 's' || (page_id % 3) END AS server,"
    " CASE WHEN html = '' THEN 'no response' END AS error,"
    " CASE WHEN html <> '' THEN length(html) END AS n,"
    " CASE WHEN html <> '' THEN (page_id % 40) / 8.0 END AS t FROM web) GROUP BY server, error",
    "web",
)
def fetch_metrics(spark, sf):
    """Pages with metrics written as files, and read with the metrics schema."""
    path = streams.shared_folder(spark, "pages-with-metrics")
    _with_metrics(pages_of(spark, sf)).write.parquet(path)
    stored = read_pages(spark, path, schema=PAGE_WITH_METRICS_SCHEMA)
    pages = enhanced_scan(stored, scan_ts=F.expr(SCAN_TS))
    return pages.groupBy(
        F.try_element_at("metrics.headers", F.lit("Server")).alias("server"),
        F.col("metrics.error").alias("error"),
    ).agg(
        F.count("*").alias("pages"),
        F.sum("metrics.content_length").alias("chars"),
        F.round(F.avg("metrics.response_time"), 4).alias("mean_time"),
    )


@query("SELECT resource_type, count(*) AS n, count(DISTINCT url) AS urls FROM req GROUP BY 1", "req")
def request_log(spark, sf):
    return (
        requests_of_pages(pages_of(spark, sf))
        .groupBy("resource_type")
        .agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))
    )


@query(
    "SELECT page_id, url, resource_type, 'p' || page_id AS accept, count(*) AS n FROM req GROUP BY ALL",
    "req",
)
def request_log_file(spark, sf):
    """The request log written as JSON lines, and read back by the request source."""
    path = streams.shared_folder(spark, "requests")
    headers = F.create_map(F.lit("Accept"), F.concat(F.lit("p"), F.col("page_id")))
    requests_of_pages(pages_of(spark, sf)).withColumn("headers", headers).write.json(path)
    return (
        read_requests(spark, path)
        .groupBy("page_id", "url", "resource_type", F.col("headers.Accept").alias("accept"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "SELECT page_id, url, pixels AS pixel_count, js AS js_tracker_count, total AS total_trackers,"
    " CASE WHEN error IS NULL THEN score END AS privacy_score, error,"
    " strftime(scan_ts, '%Y-%m-%d %H:%M:%S') AS scanned_at FROM scored",
    "scored",
)
def json_round_trip(spark, sf):
    """Results written as JSON lines and read back."""
    path = streams.shared_folder(spark, "results")
    results.write_json(scanned(spark, sf), path)
    return results.read_json(spark, path).select(
        "page_id",
        "url",
        long("pixel_count"),
        long("js_tracker_count"),
        long("summary.total_trackers"),
        long("privacy_analysis.privacy_score"),
        "error",
        F.date_format("scan_timestamp", "yyyy-MM-dd HH:mm:ss").alias("scanned_at"),
    )


@query("SELECT page_id, score AS privacy_score, overall_risk FROM escore", "escore")
def enhanced_json(spark, sf):
    """Enhanced results written as JSON text, read back by path."""
    path = streams.shared_folder(spark, "enhanced")
    results.write_enhanced_json(enhanced(spark, sf), path)
    row = F.from_json(
        "value", "page_id bigint, privacy_score bigint, risk_assessment struct<overall_risk:string>"
    )
    return (
        spark.read.schema("value string")
        .text(path)
        .select(row.alias("r"))
        .select("r.page_id", "r.privacy_score", "r.risk_assessment.overall_risk")
    )


@query(
    "SELECT page_id, 'pixel' AS family, element_type AS type, tracking_domain AS domain, src AS detail"
    " FROM px UNION ALL SELECT page_id, 'pixel', 'img', NULL, src FROM b64"
    " UNION ALL SELECT page_id, 'javascript', 'external_script', domain, src FROM ext"
    " UNION ALL SELECT page_id, 'javascript', 'inline_script', NULL, pattern FROM inl"
    " UNION ALL SELECT page_id, 'meta', type, NULL, coalesce(name, property) FROM meta"
    " UNION ALL SELECT page_id, 'css', type, domain, url FROM css",
    "px", "b64", "ext", "inl", "meta", "css",
)
def detection_export(spark, sf):
    """The flat export, written as parquet and read back."""
    path = streams.shared_folder(spark, "export")
    results.export_parquet(scanned(spark, sf), path)
    return spark.read.parquet(path).select("page_id", "family", "type", "domain", "detail")


@query(SQL["detection_export"])
def detection_csv(spark, sf):
    """The flat export, written as CSV and read back."""
    path = streams.shared_folder(spark, "export-csv")
    results.export_csv(scanned(spark, sf), path)
    return results.read_export_csv(spark, path).select(
        "page_id", "family", "type", "domain", "detail"
    )


# --- elements ------------------------------------------------------------------------------


def element_rows(spark, sf) -> DataFrame:
    return pages_of(spark, sf).select(
        "page_id", F.inline(lex.all_elements(F.col("html")))
    )


@query("SELECT tag, count(*) AS n FROM every WHERE NOT ns GROUP BY tag", "every")
def element_counts(spark, sf):
    return element_rows(spark, sf).groupBy("tag").agg(F.count("*").alias("n"))


@query(
    "SELECT page_id, tag, a_src AS src FROM ev WHERE ns AND tag IN ('img', 'iframe')", "ev"
)
def noscript_elements(spark, sf):
    return (
        pages_of(spark, sf)
        .select("page_id", F.inline(lex.scan_elements(F.col("html"))))
        .filter("in_noscript")
        .select("page_id", "tag", lex.attribute(F.col("attrs"), "src").alias("src"))
    )


@query(
    "SELECT tag, name, count(*) AS n, count(DISTINCT value) AS distinct_values, CAST(sum(length(value))"
    " AS BIGINT) AS chars FROM (SELECT e.tag, a.name, a.value FROM attrs a JOIN every e"
    " ON a.page_id = e.page_id AND a.ns = e.ns AND a.pos = e.pos WHERE NOT a.ns) GROUP BY tag, name",
    "attrs", "every",
)
def element_attributes(spark, sf):
    return (
        element_rows(spark, sf)
        .select("tag", F.inline("attrs"))
        .groupBy("tag", "name")
        .agg(
            F.count("*").alias("n"),
            F.count_distinct("value").alias("distinct_values"),
            F.sum(F.length("value")).alias("chars"),
        )
    )


@query(
    "SELECT page_id, tag, md5(body) AS body_hash, length(body) AS chars FROM every"
    " WHERE NOT ns AND tag IN ('script', 'style')",
    "every",
)
def element_texts(spark, sf):
    return (
        element_rows(spark, sf)
        .filter(F.col("tag").isin("script", "style"))
        .select(
            "page_id",
            "tag",
            F.md5("body").alias("body_hash"),
            F.length("body").cast("long").alias("chars"),
        )
    )


@query(
    "SELECT e.page_id, e.tag, e.a_style AS style FROM ev e WHERE NOT e.ns AND EXISTS (SELECT 1 FROM"
    " attrs a WHERE a.page_id = e.page_id AND a.ns = e.ns AND a.pos = e.pos AND a.name = 'style')",
    "ev", "attrs",
)
def styled_elements(spark, sf):
    attrs = F.col("attrs")
    return (
        element_rows(spark, sf)
        .filter(lex.has_attribute(attrs, "style"))
        .select("page_id", "tag", lex.attribute(attrs, "style").alias("style"))
    )


@query(
    "SELECT page_id, substr(tok, 1, 200) AS snippet, substr(tok, 1, 80) || '...' AS short FROM every"
    " WHERE NOT ns AND tag = 'script'",
    "every",
)
def element_snippets(spark, sf):
    return (
        element_rows(spark, sf)
        .filter(F.col("tag") == "script")
        .select(
            "page_id",
            lex.snippet(F.col("source")).alias("snippet"),
            dotted(F.col("source"), 80).alias("short"),
        )
    )


# --- detections ----------------------------------------------------------------------------


@query(
    "SELECT page_id, element_type, src, width, height, is_1x1_pixel, tracking_domain,"
    " has_tracking_params, in_noscript, CAST(NULL AS BOOLEAN) AS is_base64,"
    " CAST(NULL AS VARCHAR) AS tracking_type FROM px UNION ALL"
    " SELECT page_id, 'img', src, width, height, NULL, NULL, NULL, NULL, true, 'base64_pixel' FROM b64",
    "px", "b64",
)
def tracking_pixels(spark, sf):
    return (
        detections(scanned(spark, sf), "tracking_pixels")
        .drop("full_element")
    )


@query("SELECT page_id, src, width, height FROM px WHERE is_1x1_pixel", "px")
def one_pixel_images(spark, sf):
    return (
        detections(scanned(spark, sf), "tracking_pixels")
        .filter("is_1x1_pixel")
        .select("page_id", "src", "width", "height")
    )


@query("SELECT page_id, src FROM px WHERE has_tracking_params", "px")
def tracking_word_images(spark, sf):
    return (
        detections(scanned(spark, sf), "tracking_pixels")
        .filter("has_tracking_params")
        .select("page_id", "src")
    )


@query("SELECT page_id, src, width, height FROM b64", "b64")
def base64_pixels(spark, sf):
    return (
        detections(scanned(spark, sf), "tracking_pixels")
        .filter("is_base64")
        .select("page_id", "src", "width", "height")
    )


@query("SELECT * FROM meta", "meta")
def meta_trackers(spark, sf):
    return detections(scanned(spark, sf), "meta_trackers").drop("element")


@query("SELECT * FROM css", "css")
def css_trackers(spark, sf):
    return detections(scanned(spark, sf), "css_trackers").drop("element")


@query("SELECT page_id, domain, src FROM ext", "ext")
def external_scripts(spark, sf):
    return (
        detections(scanned(spark, sf), "javascript_trackers")
        .filter("type = 'external_script'")
        .select("page_id", "domain", "src")
    )


@query("SELECT page_id, pattern, content_snippet FROM inl", "inl")
def inline_scripts(spark, sf):
    return (
        detections(scanned(spark, sf), "javascript_trackers")
        .filter("type = 'inline_script'")
        .select("page_id", "pattern", "content_snippet")
    )


@query(
    "SELECT f.family, f.pattern, count(*) AS scripts, count(DISTINCT e.page_id) AS pages FROM ev e JOIN fam f"
    " ON regexp_matches(e.body, '(?i)' || f.pattern) WHERE NOT e.ns AND e.tag = 'script'"
    " AND e.body <> '' GROUP BY f.family, f.pattern",
    "ev", "fam",
)
def pattern_families(spark, sf):
    """User pattern tables in join form."""
    bodies = scripts.script_bodies(basic_scan.extract_elements(pages_of(spark, sf)))
    return (
        scripts.join_patterns(bodies, seeds.pattern_families(spark).select("family", "pattern"))
        .groupBy("family", "pattern")
        .agg(F.count("*").alias("scripts"), F.count_distinct("page_id").alias("pages"))
    )


CUSTOM = [r"canvas\.\w+", "RTCPeer"]


@query(
    "SELECT e.page_id, c.pattern FROM ev e JOIN (SELECT pattern FROM pat UNION ALL SELECT * FROM (VALUES "
    + sql.rows((p,) for p in CUSTOM)
    + ") t(pattern)) c ON regexp_matches(e.body, '(?i)' || c.pattern) WHERE NOT e.ns"
    " AND e.tag = 'script' AND e.body <> ''",
    "ev", "pat",
)
def custom_patterns(spark, sf):
    """Patterns added to the built-in list."""
    return (
        detections(scanned(spark, sf, custom_patterns=CUSTOM), "javascript_trackers")
        .filter("type = 'inline_script'")
        .select("page_id", "pattern")
    )


@query(
    "SELECT page_id, tracker_type, domain, source, category, risk_level, purpose FROM finger", "finger"
)
def fingerprint_rules(spark, sf):
    return _trackers(spark, sf).filter("tracker_type <> 'javascript'")


def _trackers(spark, sf) -> DataFrame:
    return (
        enhanced(spark, sf)
        .select("page_id", F.inline_outer("trackers"))
        .filter("tracker_type IS NOT NULL")
        .drop("first_seen", "details")
    )


# --- score and categories ------------------------------------------------------------------


@query(
    "SELECT page_id, pixels AS pixel_count, js AS js_tracker_count, metas AS meta_tracker_count,"
    " css AS css_tracker_count, total AS total_trackers FROM res",
    "res",
)
def page_counts(spark, sf):
    return reports.page_counts(scanned(spark, sf)).select(
        "page_id",
        *[
            long(f"{n}_count")
            for n in ("pixel", "js_tracker", "meta_tracker", "css_tracker")
        ],
        long("total_trackers"),
    )


@query(
    "SELECT w.page_id, count(p.domain) AS n_domains,"
    " CASE WHEN html <> '' THEN coalesce(string_agg(p.domain, ',' ORDER BY p.domain), '') END AS domains"
    " FROM web w LEFT JOIN pd p ON w.page_id = p.page_id GROUP BY w.page_id, w.html",
    "web", "pd",
)
def page_domains(spark, sf):
    found = F.col("summary.domains_found")
    return scanned(spark, sf).select(
        "page_id",
        F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_domains"),
        F.array_join(found, ",").alias("domains"),
    )


@query(
    "SELECT page_id, string_agg(domain, ',' ORDER BY domain) AS domains, count(*) AS n FROM bag"
    " GROUP BY page_id",
    "bag",
)
def domain_bags(spark, sf):
    """Found domains with repeats, as they enter the score."""
    return (
        scanned(spark, sf)
        .filter(F.size("domains") > 0)
        .select(
            "page_id",
            F.array_join(F.array_sort("domains"), ",").alias("domains"),
            F.size("domains").cast("long").alias("n"),
        )
    )


@query("SELECT page_id, true AS is_now FROM web", "web")
def scan_times(spark, sf):
    """Without a given time a scan takes the time at which it runs."""
    now = F.current_timestamp()
    return scan(pages_of(spark, sf), with_source=False).select(
        "page_id", (F.col("scan_timestamp") == now).alias("is_now")
    )


@query(
    "SELECT page_id, url, CASE WHEN error IS NULL THEN score END AS privacy_score, risk AS risk_level,"
    " error FROM scored",
    "scored",
)
def privacy_scores(spark, sf):
    return scanned(spark, sf).select(
        "page_id",
        "url",
        long("privacy_analysis.privacy_score"),
        "privacy_analysis.risk_level",
        "error",
    )


WEIGHTS = ScoringParams(
    tracking_pixel=2, external_script=20, inline_script=1.5, high_risk_domain=5, low=90, medium=70
)


@query(
    "SELECT page_id, s AS privacy_score, CASE WHEN s > 90 THEN 'Low' WHEN s > 70 THEN 'Medium' ELSE"
    " 'High' END AS risk_level FROM (SELECT page_id, CAST(greatest(0, 100 - 2 * n_pixels - 20 * n_ext"
    " - 1.5 * n_inl - 5 * n_risky) AS DOUBLE) AS s FROM res WHERE error IS NULL)",
    "res",
)
def custom_weights(spark, sf):
    return (
        scanned(spark, sf, params=WEIGHTS)
        .filter("error IS NULL")
        .select(
            "page_id",
            F.col("privacy_analysis.privacy_score").cast("double").alias("privacy_score"),
            "privacy_analysis.risk_level",
        )
    )


def _no_noscript(pages: DataFrame) -> DataFrame:
    """A parser of the user: the default one without the noscript pass."""
    return basic_scan.extract_elements(pages).withColumn(
        "elements", F.filter("elements", lambda e: ~e["in_noscript"])
    )


@query(
    "SELECT w.page_id, count(p.page_id) AS pixel_count FROM web w LEFT JOIN (SELECT page_id FROM px"
    " WHERE NOT in_noscript UNION ALL SELECT page_id FROM b64) p ON w.page_id = p.page_id"
    " WHERE html <> '' GROUP BY w.page_id",
    "web", "px", "b64",
)
def custom_parser(spark, sf):
    return (
        scanned(spark, sf, extract=_no_noscript)
        .filter("error IS NULL")
        .select("page_id", long("pixel_count"))
    )


def _count_score(found: DataFrame) -> DataFrame:
    """An analyser of the user: a point per script only."""
    analysis = F.struct((100 - F.size("javascript_trackers")).alias("privacy_score"))
    return found.withColumn("privacy_analysis", analysis)


@query("SELECT page_id, 100 - js AS privacy_score FROM res WHERE error IS NULL", "res")
def custom_analyser(spark, sf):
    return (
        scanned(spark, sf, score=_count_score)
        .filter("error IS NULL")
        .select("page_id", long("privacy_analysis.privacy_score"))
    )


@query(
    "SELECT w.page_id, coalesce(string_agg(c.category, ',' ORDER BY c.category), '') AS categories"
    " FROM web w LEFT JOIN pcat c ON w.page_id = c.page_id WHERE html <> '' GROUP BY w.page_id",
    "web", "pcat",
)
def page_categories(spark, sf):
    return (
        scanned(spark, sf)
        .filter("error IS NULL")
        .select("page_id", joined("privacy_analysis.detected_categories", "categories"))
    )


@query(
    "SELECT page_id, domain, count(*) AS n FROM risky WHERE category IN ('advertising', 'social_media')"
    " GROUP BY page_id, domain",
    "risky",
)
def high_risk_domains(spark, sf):
    """High-risk domains with the number of times each costs points."""
    return (
        scanned(spark, sf)
        .select("page_id", F.explode_outer("privacy_analysis.high_risk_domains").alias("domain"))
        .filter("domain IS NOT NULL")
        .groupBy("page_id", "domain")
        .agg(F.count("*").alias("n"))
    )


@query(
    "SELECT category, domain, count(*) AS n, count(DISTINCT page_id) AS pages FROM risky"
    " GROUP BY category, domain",
    "risky",
)
def domain_categories(spark, sf):
    """Categories of the found domains, with the times and pages each domain was found."""
    bag = scanned(spark, sf).select("page_id", F.explode_outer("domains").alias("domain"))
    return (
        bag.filter("domain IS NOT NULL")
        .groupBy("domain")
        .agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))
        .select(
            F.explode(scoring.domain_categories(F.col("domain"))).alias("category"),
            "domain",
            "n",
            "pages",
        )
    )


ADVICE = (
    "concat_ws('|', CASE WHEN a THEN 'Consider using ad blockers or privacy-focused browsers|"
    "Review and adjust ad personalization settings' END,"
    " CASE WHEN s THEN 'Disable social media tracking in browser settings|"
    "Use privacy extensions to block social media trackers' END,"
    " CASE WHEN n_risky > 0 THEN 'High-risk tracking domains detected - consider VPN usage' END,"
    " CASE WHEN y THEN 'Analytics tracking detected - consider opting out if possible' END)"
)


_ADVISED = (
    "SELECT page_id, CASE WHEN advice = '' THEN 'Minimal tracking detected - privacy impact is low'"
    f" ELSE advice END AS advice FROM (SELECT page_id, {ADVICE} AS advice FROM (SELECT r.page_id,"
    " r.n_risky, coalesce(bool_or(category = 'advertising'), false) AS a,"
    " coalesce(bool_or(category = 'social_media'), false) AS s,"
    " coalesce(bool_or(category = 'analytics'), false) AS y FROM res r LEFT JOIN pcat c"
    " ON r.page_id = c.page_id WHERE r.error IS NULL GROUP BY r.page_id, r.n_risky))"
)


@query(_ADVISED, "res", "pcat")
def recommendations(spark, sf):
    return (
        scanned(spark, sf)
        .filter("error IS NULL")
        .select("page_id", F.array_join("privacy_analysis.recommendations", "|").alias("advice"))
    )


# --- catalogue -----------------------------------------------------------------------------


def _match_text():
    return F.array_join(
        F.transform("matches", lambda m: F.concat(m["pattern"], F.lit(":"), m["type"])), "|"
    ).alias("matches")


CATALOGUE_SELECT = (
    "SELECT d.page_id, d.tracker_id, c.name, c.category, c.risk_level, c.description, c.data_types,"
    " c.gdpr_relevant, c.ccpa_relevant, c.evasion_techniques, d.matches FROM det d JOIN cat c"
    " ON d.tracker_id = c.tracker_id"
)


def _flat(found: DataFrame) -> DataFrame:
    return found.select(
        "page_id",
        "tracker_id",
        "name",
        "category",
        "risk_level",
        "description",
        F.array_join("data_types", ";").alias("data_types"),
        "gdpr_relevant",
        "ccpa_relevant",
        F.array_join("evasion_techniques", ";").alias("evasion_techniques"),
        _match_text(),
    )


@query(CATALOGUE_SELECT, "det", "cat")
def catalogue_detections(spark, sf):
    return _flat(detected(spark, sf))


@query(CATALOGUE_SELECT, "det", "cat")
def catalogue_table_detections(spark, sf):
    """The same with the catalogue as a table known at run time."""
    return _flat(catalog.detect_with_table(pages_of(spark, sf), seeds.catalogue(spark)))


@query(
    "SELECT d.page_id, c.name FROM det d JOIN cat c ON d.tracker_id = c.tracker_id"
    " WHERE c.category = 'advertising'",
    "det", "cat",
)
def category_detections(spark, sf):
    return catalog.by_category(detected(spark, sf), "advertising").select("page_id", "name")


@query(
    "SELECT d.page_id, c.name, c.risk_level FROM det d JOIN cat c ON d.tracker_id = c.tracker_id"
    " WHERE c.risk_level IN ('high', 'critical')",
    "det", "cat",
)
def high_risk_detections(spark, sf):
    return catalog.high_risk(detected(spark, sf)).select("page_id", "name", "risk_level")


@query(
    "SELECT p.domain, count(*) AS pages, (SELECT arg_min(h.tracker_id, c.ord) FROM chost h JOIN cat c"
    " ON h.tracker_id = c.tracker_id WHERE h.domain = p.domain) AS tracker_id FROM pd p GROUP BY p.domain",
    "pd", "chost", "cat",
)
def domain_lookup(spark, sf):
    """The catalogue tracker of every domain found on the pages."""
    return catalog.lookup(reports.domain_pages(scanned(spark, sf)), seeds.catalogue(spark)).select(
        "domain", "pages", "tracker_id"
    )


_TOTALS = (
    "SELECT 'total_trackers' AS statistic, '' AS value, count(*) AS count FROM seen"
    " UNION ALL SELECT 'total_domains', '', (SELECT count(*) FROM chost SEMI JOIN seen USING (tracker_id))"
    " UNION ALL SELECT 'total_patterns', '', (SELECT count(*) FROM cpat SEMI JOIN seen USING (tracker_id))"
    " UNION ALL SELECT 'gdpr_relevant_count', '', count(*) FILTER (gdpr_relevant) FROM seen"
    " UNION ALL SELECT 'ccpa_relevant_count', '', count(*) FILTER (ccpa_relevant) FROM seen"
)
_GROUPS = " UNION ALL ".join(
    f"SELECT '{c}', {c}, count(*) FROM seen GROUP BY {c}"
    for c in ("category", "risk_level", "detection_method")
)


@query(f"{_TOTALS} UNION ALL {_GROUPS}", "seen", "chost", "cpat")
def catalogue_statistics(spark, sf):
    """Catalogue statistics of the trackers found on the pages."""
    return catalog.statistics(seen_trackers(spark, sf))


_TITLED = (
    "array_to_string(list_transform(string_split(replace(value, '_', ' '), ' '),"
    " lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
)


@query(
    f"SELECT statistic, {_TITLED} AS value, count FROM ({_TOTALS} UNION ALL {_GROUPS}) UNION ALL"
    " SELECT 'high_risk_tracker', name || ' (' || category || ') - ' || risk_level, 1 FROM seen"
    " WHERE risk_level IN ('high', 'critical')",
    "seen", "chost", "cpat",
)
def catalogue_summary(spark, sf):
    return catalog.summary(seen_trackers(spark, sf))


@query(
    'SELECT s.tracker_id AS "Tracker ID", name AS "Name", category AS "Category", risk_level AS "Risk Level",'
    " description AS \"Description\", coalesce((SELECT string_agg(domain, ';' ORDER BY pos) FROM chost h"
    " WHERE h.tracker_id = s.tracker_id), '') AS \"Domains\", (SELECT count(*) FROM cpat p WHERE"
    ' p.tracker_id = s.tracker_id) AS "Pattern Count",'
    " CASE WHEN gdpr_relevant THEN 'True' ELSE 'False' END AS \"GDPR Relevant\","
    " CASE WHEN ccpa_relevant THEN 'True' ELSE 'False' END AS \"CCPA Relevant\","
    ' data_types AS "Data Types", evasion_techniques AS "Evasion Techniques", first_seen AS "First Seen"'
    " FROM seen s",
    "seen", "chost", "cpat",
)
def catalogue_csv(spark, sf):
    """CSV rows of the trackers found on the pages."""
    return catalog_files.csv_rows(seen_trackers(spark, sf)).withColumn(
        "Pattern Count", F.col("`Pattern Count`").cast("long")
    )


_LISTED = (
    "SELECT s.tracker_id, name, category, risk_level, description, coalesce((SELECT"
    " string_agg(domain, ';' ORDER BY pos) FROM chost h WHERE h.tracker_id = s.tracker_id), '') AS"
    " domains, (SELECT count(*) FROM cpat p WHERE p.tracker_id = s.tracker_id) AS pattern_count,"
    " gdpr_relevant, ccpa_relevant, data_types, evasion_techniques, first_seen FROM seen s"
)


def _listed(catalogue: DataFrame) -> DataFrame:
    lists = ("domains", "data_types", "evasion_techniques")
    return catalogue.select(
        *("tracker_id", "name", "category", "risk_level", "description"),
        *(F.array_join(c, ";").alias(c) for c in lists),
        *(long("pattern_count"), "gdpr_relevant", "ccpa_relevant", day("first_seen").alias("first_seen")),
    )


@query(_LISTED, "seen", "chost", "cpat")
def catalogue_csv_file(spark, sf):
    """The catalogue of the trackers found, written as CSV and read back."""
    path = streams.shared_folder(spark, "catalogue-csv")
    catalog_files.write_csv(seen_trackers(spark, sf), path)
    return _listed(catalog_files.read_csv(spark, path))


@query(_LISTED, "seen", "chost", "cpat")
def catalogue_json_file(spark, sf):
    """The same as JSON lines, read by the catalogue's schema."""
    path = streams.shared_folder(spark, "catalogue-json")
    catalog_files.write_json(seen_trackers(spark, sf), path)
    rows = spark.read.schema(seeds.CATALOGUE_SCHEMA).json(path)
    return _listed(rows.withColumn("pattern_count", F.size("patterns")))


@query(
    "SELECT d.ord, d.domain, count(b.domain) AS findings FROM dom d LEFT JOIN bag b"
    " ON b.domain = d.domain WHERE d.ord < 10 GROUP BY 1, 2",
    "dom", "bag",
)
def first_domains(spark, sf):
    """How often each of the first ten listed domains was found."""
    found = (
        scanned(spark, sf)
        .select(F.explode("domains").alias("domain"))
        .groupBy("domain")
        .agg(F.count("*").alias("findings"))
    )
    return (
        seeds.first_domains(spark)
        .join(found, "domain", "left")
        .select(long("ord"), "domain", F.coalesce("findings", F.lit(0)).alias("findings"))
    )


@query(
    "SELECT d.page_id, count(*) FILTER (gdpr_relevant) AS gdpr_count, count(*) FILTER (ccpa_relevant)"
    " AS ccpa_count, count(*) AS tracker_count FROM det d JOIN cat c ON d.tracker_id = c.tracker_id"
    " GROUP BY d.page_id",
    "det", "cat",
)
def compliance_exposure(spark, sf):
    return catalog.compliance(detected(spark, sf))


@query(
    "SELECT d.tracker_id, c.name, count(*) AS pages FROM det d JOIN cat c ON d.tracker_id = c.tracker_id"
    " GROUP BY 1, 2 ORDER BY pages DESC, d.tracker_id LIMIT 5",
    "det", "cat",
)
def common_trackers(spark, sf):
    return reports.common_trackers(detected(spark, sf), 5)


# --- enhanced path -------------------------------------------------------------------------


@query("SELECT * FROM enh", "enh")
def enhanced_trackers(spark, sf):
    return _trackers(spark, sf)


@query("SELECT page_id, domain, source AS src, category, risk_level AS risk, purpose FROM hosts", "hosts")
def host_intelligence(spark, sf):
    """Script hosts against the host table, as an equality join."""
    rows = pages_of(spark, sf).select(
        "page_id", F.inline(intel.external_scripts(lex.scan_elements(F.col("html"))))
    )
    return intel.join_hosts(rows.drop("element"), seeds.host_intelligence(spark))


@query(
    "SELECT page_id, trackers AS tracker_count, score AS privacy_score, overall_risk FROM escore",
    "escore",
)
def enhanced_scores(spark, sf):
    return enhanced(spark, sf).select(
        "page_id",
        long("tracker_count"),
        long("privacy_score"),
        "risk_assessment.overall_risk",
    )


@query(
    "SELECT w.page_id, coalesce((SELECT string_agg(DISTINCT domain, ',' ORDER BY domain) FROM enh e WHERE"
    " e.page_id = w.page_id), '') AS domains, coalesce((SELECT string_agg(DISTINCT tracker_type, ','"
    " ORDER BY tracker_type) FROM enh e WHERE e.page_id = w.page_id), '') AS methods,"
    " concat_ws(',', CASE WHEN (SELECT bool_or(category = 'advertising') FROM enh e WHERE e.page_id ="
    " w.page_id) THEN 'behavioral_profiling' END, CASE WHEN (SELECT bool_or(category = 'analytics')"
    " FROM enh e WHERE e.page_id = w.page_id) THEN 'usage_analytics' END) AS collection FROM web w",
    "web", "enh",
)
def risk_details(spark, sf):
    return enhanced(spark, sf).select(
        "page_id",
        joined("risk_assessment.third_party_domains", "domains"),
        joined("risk_assessment.tracking_methods", "methods"),
        joined("risk_assessment.data_collection", "collection"),
    )


@query(
    "SELECT count(*) AS total_urls, CAST(sum(trackers) AS BIGINT) AS total_trackers,"
    " round(avg(score), 6) AS average_privacy_score, (SELECT count(DISTINCT domain) FROM enh)"
    " AS unique_tracking_domains FROM escore",
    "escore", "enh",
)
def intelligence_report(spark, sf):
    return reports.intelligence_summary(enhanced(spark, sf)).withColumn(
        "average_privacy_score", F.round("average_privacy_score", 6)
    )


@query(
    "SELECT category, count(*) AS count FROM enh GROUP BY category ORDER BY count DESC, category LIMIT 10",
    "enh",
)
def top_categories(spark, sf):
    return reports.top_categories(enhanced(spark, sf))


@query(
    "SELECT domain, count(DISTINCT page_id) AS pages FROM enh GROUP BY domain"
    " ORDER BY pages DESC, domain LIMIT 20",
    "enh",
)
def most_tracked_domains(spark, sf):
    return reports.most_tracked_domains(enhanced(spark, sf))


# --- requests and addresses ----------------------------------------------------------------


@query(
    "SELECT page_id, url, parameter FROM (SELECT page_id, url,"
    " regexp_extract(p, '(?s)^([^=]*)=', 1) AS parameter FROM (SELECT page_id, url,"
    f" unnest(string_split(regexp_extract(url, {text(sql.QUERY)}, 1), '&')) AS p FROM req)"
    " WHERE regexp_matches(p, '(?s)^[^=]*=.'))"
    " WHERE regexp_matches(lower(parameter), 'utm_|fbclid|gclid|_ga|mc_eid')",
    "req",
)
def tracking_parameters(spark, sf):
    return requests.tracking_parameters(requests_of_pages(pages_of(spark, sf)))


@query(
    f"SELECT page_id, {host('url')} AS domain, url AS source FROM req WHERE contains(lower(url), 'pixel')"
    f" AND regexp_matches(regexp_extract(url, {text(sql.PATH)}, 1), '\\.(gif|png|jpg)$')",
    "req",
)
def pixel_requests(spark, sf):
    return requests.pixel_requests(requests_of_pages(pages_of(spark, sf))).select(
        "page_id", "domain", "source"
    )


@query(
    "SELECT page_id, CASE WHEN starts_with(bare, 'http://') OR starts_with(bare, 'https://') THEN bare"
    f" ELSE 'https://' || bare END AS full_url, {host('url')} AS netloc,"
    f" regexp_extract(url, {text(sql.PATH)}, 1) AS path, regexp_extract(url, {text(sql.QUERY)}, 1)"
    " AS query, coalesce((SELECT string_agg(DISTINCT k, ',' ORDER BY k) FROM (SELECT"
    " regexp_extract(p, '^([^=]*)=', 1) AS k FROM (SELECT unnest(string_split(regexp_extract(url,"
    f" {text(sql.QUERY)}, 1), '&')) AS p) WHERE regexp_matches(p, '^[^=]*=.'))), '') AS keys,"
    " starts_with(lower(url), 'https://') AS is_https FROM (SELECT *, CASE WHEN page_id % 2 = 0"
    " THEN regexp_replace(url, '^https?://', '') ELSE url END AS bare FROM pages)"
)
def url_parts(spark, sf):
    url = F.col("url")
    bare = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(url, "^https?://", "")).otherwise(url)
    return load(spark, sf, "pages").select(
        "page_id",
        urls.with_scheme(bare).alias("full_url"),
        urls.netloc(url).alias("netloc"),
        urls.path(url).alias("path"),
        urls.query(url).alias("query"),
        F.array_join(F.array_sort(urls.query_keys(url)), ",").alias("keys"),
        urls.is_https(url).alias("is_https"),
    )


# --- reports -------------------------------------------------------------------------------


@query(
    "SELECT count(*) AS total_sites_scanned, CAST(coalesce(sum(total), 0) AS BIGINT) AS total_trackers_found,"
    " (SELECT count(DISTINCT domain) FROM bag) AS unique_tracking_domains,"
    " round(coalesce(sum(total), 0) / count(*), 6) AS average_trackers_per_site FROM res",
    "res", "bag",
)
def batch_totals(spark, sf):
    return reports.batch_totals(scanned(spark, sf)).withColumn(
        "average_trackers_per_site", F.round("average_trackers_per_site", 6)
    )


@query(
    "SELECT domain, count(*) AS pages FROM pd GROUP BY domain ORDER BY pages DESC, domain LIMIT 10", "pd"
)
def top_domains(spark, sf):
    return reports.top_domains(scanned(spark, sf), 10)


@query("SELECT DISTINCT domain FROM bag", "bag")
def distinct_domains(spark, sf):
    return reports.distinct_domains(scanned(spark, sf))


_GOOD = "(SELECT *, strftime(scan_ts, '%Y-%m-%d') AS day FROM scored WHERE error IS NULL)"


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS statistic, {v} AS value, count(*) AS scans, CAST(sum(total) AS BIGINT) AS trackers,"
        f" round(avg(score), 6) AS mean_score FROM {_GOOD}{g}"
        for n, v, g in (
            ("total", "''", ""),
            ("risk_level", "risk", " GROUP BY risk"),
            ("day", "day", " GROUP BY day"),
        )
    ),
    "scored",
)
def scan_statistics(spark, sf):
    return reports.api_statistics(scanned(spark, sf)).withColumn(
        "mean_score", F.round("mean_score", 6)
    )


_EDGES = (25, 50, 75, 100)
_TIMES = (1, 2.5)


def _edge(column: str, edges) -> str:
    cases = " ".join(f"WHEN {column} <= {e} THEN '{float(e)}'" for e in edges)
    return f"CASE {cases} ELSE 'inf' END"


@query(
    "SELECT metric, edge, CAST(sum(amount) AS BIGINT) AS value FROM ("
    "SELECT 'scans_total' AS metric, '' AS edge, 1 AS amount FROM good UNION ALL"
    " SELECT 'trackers_detected_total', '', total FROM good UNION ALL"
    f" SELECT 'scan_duration_seconds', {_edge('(page_id % 40) / 8.0', _TIMES)}, 1 FROM good UNION ALL"
    f" SELECT 'privacy_score_histogram', {_edge('score', _EDGES)}, 1 FROM good) GROUP BY metric, edge"
    .replace("FROM good", "FROM (SELECT * FROM scored WHERE error IS NULL)"),
    "scored",
)
def scan_metrics(spark, sf):
    return _metric_rows(reports.metrics(_timed(scanned(spark, sf)), _EDGES, _TIMES))


def _timed(scans: DataFrame) -> DataFrame:
    return scans.filter("error IS NULL").select(
        F.col("summary.total_trackers").alias("tracker_count"),
        "privacy_analysis.privacy_score",
        (F.col("page_id") % 40 / 8).alias("scan_duration"),
    )


def _metric_rows(values: DataFrame) -> DataFrame:
    edge = F.when(F.col("le").isNull(), "").when(F.col("le") == float("inf"), "inf")
    return values.select(
        "metric", edge.otherwise(F.col("le").cast("string")).alias("edge"), "value"
    )


def _batches_of(spark, sf, name, parts, merge) -> DataFrame:
    """The pages in three batches, each rolled up on its own. The second is written twice, the
    first two are compacted, and the first comes again after that; each counts once."""
    path = streams.shared_folder(spark, name)
    pages = pages_of(spark, sf)

    def write(batch: int) -> None:
        own = pages.filter(F.pmod(F.xxhash64("page_id"), F.lit(3)) == batch)
        rollups.write_batch(parts(scan(own, scan_ts=F.expr(SCAN_TS), with_source=False)), path, batch)

    for batch in (0, 1, 1):
        write(batch)
    rollups.compact(spark, path, 1, merge)
    for batch in (2, 0):
        write(batch)
    return merge(rollups.stored(spark, path))


@query(SQL["scan_statistics"])
def rollup_statistics(spark, sf):
    """The statistics out of daily rollups of three batches."""
    parts = _batches_of(spark, sf, "rollup", rollups.daily_parts, rollups.merge_daily)
    return rollups.statistics(parts).withColumn("mean_score", F.round("mean_score", 6))


@query(SQL["scan_metrics"])
def rollup_metrics(spark, sf):
    """The metrics table out of the counters of three batches."""

    def parts(scanned_pages: DataFrame) -> DataFrame:
        return rollups.metric_parts(_timed(scanned_pages), _EDGES, _TIMES)

    return _metric_rows(_batches_of(spark, sf, "metrics", parts, rollups.merge_metrics))


@query(
    "SELECT CAST(least(floor(score / 10) + 1, 10) AS BIGINT) AS bucket, count(*) AS pages FROM scored"
    " WHERE error IS NULL GROUP BY 1",
    "scored",
)
def score_distribution(spark, sf):
    return reports.score_distribution(scanned(spark, sf))


@query(
    f"SELECT domain, strftime({TS}, '%Y-%m-%d') AS day, count(*) AS pages FROM pd GROUP BY 1, 2", "pd"
)
def domain_activity(spark, sf):
    return reports.domain_activity(scanned(spark, sf))


_DAYS = ["2024-01-01", "2024-01-02", "2024-01-03"]


@query(
    "SELECT domain, "
    + ", ".join(
        f"count(*) FILTER (strftime({TS}, '%Y-%m-%d') = '{d}') AS \"{d}\"" for d in _DAYS
    )
    + f", count(*) FILTER (strftime({TS}, '%Y-%m-%d') NOT IN ({', '.join(repr(d) for d in _DAYS)}))"
    " AS other_days FROM pd GROUP BY domain",
    "pd",
)
def domain_heatmap(spark, sf):
    return reports.heatmap(scanned(spark, sf), _DAYS)


@query(
    "SELECT s.page_id, s.url, s.error, s.total AS total_trackers, s.pixels AS pixel_count,"
    " s.js AS js_tracker_count, s.metas AS meta_tracker_count, s.css AS css_tracker_count,"
    " CASE WHEN s.error IS NULL THEN coalesce((SELECT string_agg(shown, chr(10) ORDER BY shown) FROM"
    " (SELECT page_id, concat_ws('|', element_type, substr(src, 1, 100) || '...', domain,"
    " CASE WHEN small THEN '1x1' ELSE '' END) AS shown FROM (SELECT page_id, element_type, src,"
    " tracking_domain AS domain, is_1x1_pixel AS small FROM px UNION ALL SELECT page_id, 'img', src,"
    " NULL, false FROM b64)) x WHERE x.page_id = s.page_id), '') END AS pixels,"
    f" coalesce((SELECT v.advice FROM ({_ADVISED}) v WHERE v.page_id = s.page_id), '') AS advice,"
    " CASE WHEN s.error IS NULL THEN s.score END AS privacy_score, s.risk AS risk_level,"
    " CASE WHEN s.error IS NULL THEN coalesce((SELECT string_agg(category, ', ' ORDER BY category) FROM"
    " pcat c WHERE c.page_id = s.page_id), '') END AS categories,"
    " CASE WHEN s.error IS NULL THEN coalesce((SELECT string_agg(p.domain || CASE WHEN EXISTS (SELECT 1"
    " FROM risky r WHERE r.page_id = p.page_id AND r.domain = p.domain AND r.category IN"
    " ('advertising', 'social_media')) THEN '!' ELSE '' END, ',' ORDER BY p.domain) FROM pd p WHERE"
    " p.page_id = s.page_id), '') END AS domains FROM scored s",
    "scored", "pcat", "pd", "risky", "px", "b64",
)
def report_rows(spark, sf):
    marked = F.transform(
        "domains", lambda d: F.concat(d["domain"], F.when(d["high_risk"], "!").otherwise(""))
    )
    shown = F.transform(
        "pixels",
        lambda p: F.concat_ws(
            "|",
            p["element_type"],
            p["source"],
            p["domain"],
            F.when(p["one_pixel"], "1x1").otherwise(""),
        ),
    )
    return reports.report_rows(scanned(spark, sf)).select(
        "page_id",
        "url",
        "error",
        long("total_trackers"),
        *[long(f"{kind}_count") for kind in ("pixel", "js_tracker", "meta_tracker", "css_tracker")],
        long("privacy_score"),
        "risk_level",
        "categories",
        F.array_join(marked, ",").alias("domains"),
        F.array_join(F.array_sort(shown), "\n").alias("pixels"),
        F.array_join("recommendations", "|").alias("advice"),
    )


@query(
    "SELECT page_id, risk AS risk_level, score AS privacy_score FROM scored WHERE risk = 'Low'"
    " ORDER BY scan_ts DESC, page_id LIMIT 50 OFFSET 10",
    "scored",
)
def paged_results(spark, sf):
    low = reports.by_risk(scanned(spark, sf), "Low", "privacy_analysis.risk_level")
    return reports.paged(low, 50, 10).select(
        "page_id", "privacy_analysis.risk_level", long("privacy_analysis.privacy_score")
    )


@query(
    "SELECT page_id, score AS privacy_score FROM scored WHERE risk = 'Low'"
    " ORDER BY scan_ts DESC, page_id LIMIT 50 OFFSET 40",
    "scored",
)
def next_page(spark, sf):
    """The page of results that follows the 40 rows shown before it."""
    low = reports.by_risk(scanned(spark, sf), "Low", "privacy_analysis.risk_level")
    shown = reports.seek(low, 40).select("scan_timestamp", "page_id").collect()[-1]
    return reports.seek(low, 50, tuple(shown)).select(
        "page_id", long("privacy_analysis.privacy_score")
    )


@query(
    "SELECT page_id, string_agg(pattern, ',' ORDER BY pos, ord) AS patterns FROM (SELECT *, row_number()"
    " OVER (PARTITION BY page_id ORDER BY pos, ord) AS rn FROM inl) WHERE rn <= 2 GROUP BY page_id",
    "inl",
)
def first_patterns(spark, sf):
    """The first two inline patterns of each page, as a listing shows them."""
    found = scanned(spark, sf).withColumn(
        "hits",
        F.array_compact(F.transform("javascript_trackers", lambda s: s["pattern"])),
    )
    return (
        reports.first_per_page(found, "hits", 2)
        .filter(F.size("first") > 0)
        .select("page_id", joined("first", "patterns"))
    )


# --- history and trends --------------------------------------------------------------------


@query(
    "SELECT url, strftime(scan_ts, '%Y-%m-%d %H:%M:%S') AS scanned_at, total AS tracker_count,"
    " score AS privacy_score, sha256('{\"pixel_count\":' || pixels || ',\"js_tracker_count\":' || js ||"
    " ',\"meta_tracker_count\":' || metas || ',\"css_tracker_count\":' || css || ',\"privacy_score\":' ||"
    " score || ',\"domains_found\":[' || coalesce((SELECT string_agg('\"' || domain || '\"', ',' ORDER BY"
    " domain) FROM pd p WHERE p.page_id = s.page_id), '') || '],\"high_risk_domains\":[' ||"
    " coalesce((SELECT string_agg('\"' || domain || '\"', ',' ORDER BY domain) FROM risky r WHERE"
    " r.page_id = s.page_id AND category IN ('advertising', 'social_media')), '') || ']}') AS result_hash"
    " FROM scored s WHERE error IS NULL",
    "scored", "pd", "risky",
)
def scan_history(spark, sf):
    """History rows appended to a date-partitioned table and read back."""
    path = streams.shared_folder(spark, "history")
    history.append(history.history_rows(scanned(spark, sf)), path, files_per_day=2)
    return history.read(spark, path).select(
        "url",
        F.date_format("scan_ts", "yyyy-MM-dd HH:mm:ss").alias("scanned_at"),
        long("tracker_count"),
        long("privacy_score"),
        "result_hash",
    )


AS_OF = "2024-01-31 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


@query(
    "SELECT url, count(*) AS scans, round(avg(privacy_score), 6) AS mean_score FROM hist"
    f" WHERE scan_ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY url",
    "hist",
)
def last_days(spark, sf):
    return (
        history.last_days(site_history(spark, sf), _as_of(), 7)
        .groupBy("url")
        .agg(F.count("*").alias("scans"), F.round(F.avg("privacy_score"), 6).alias("mean_score"))
    )


@query(
    "SELECT strftime(scan_ts, '%Y-%m-%d') AS day, count(*) AS scans FROM hist WHERE CAST(scan_ts AS DATE)"
    f" >= CAST(TIMESTAMP '{AS_OF}' AS DATE) - 14 GROUP BY 1",
    "hist",
)
def retained_history(spark, sf):
    return (
        history.retained(site_history(spark, sf), _as_of(), 14)
        .groupBy(day("scan_ts").alias("day"))
        .agg(F.count("*").alias("scans"))
    )


@query(
    "SELECT strftime(scan_ts, '%Y-%m-%d') AS day, count(*) AS scans, (SELECT count(DISTINCT CAST(scan_ts AS"
    " DATE)) FROM hist WHERE scan_ts >= TIMESTAMP '2024-01-17 12:30:00') AS folders FROM hist"
    " WHERE scan_ts >= TIMESTAMP '2024-01-17 12:30:00' GROUP BY 1",
    "hist",
)
def expired_history(spark, sf):
    """History is stored, what is past its retention is removed, and the rest is read back."""
    path = streams.shared_folder(spark, "expired-history")
    rows = site_history(spark, sf).select(*[c.split()[0] for c in history.HISTORY_SCHEMA.split(", ")])
    history.append(rows, path, files_per_day=2)
    history.expire(spark, path, dt.datetime(2024, 1, 31, 12, 30), 14)
    left = [n for n in folders.names(spark, path) if n.startswith("scan_date=")]
    return (
        history.read(spark, path)
        .groupBy(day("scan_date").alias("day"))
        .agg(F.count("*").alias("scans"))
        .withColumn("folders", F.lit(len(left)).cast("long"))
    )


_LEVEL = (
    "SELECT event_id, concat_ws(',', CASE WHEN privacy_score < 60 THEN 'low_privacy_score' END,"
    " CASE WHEN tracker_count > 50 THEN 'too_many_trackers' END) AS reasons FROM hist"
    " WHERE privacy_score < 60 OR tracker_count > 50"
)


@query(_LEVEL, "hist")
def level_alerts(spark, sf):
    return history.level_alerts(site_history(spark, sf)).select(
        "event_id", joined("reasons", "reasons")
    )


_PREVIOUS = (
    "(SELECT *, lag(privacy_score) OVER w AS last_score, lag(tracker_count) OVER w AS last_count,"
    " FROM hist WINDOW w AS (PARTITION BY url ORDER BY scan_ts))"
)
_CHANGED = "last_score - privacy_score >= 10 OR tracker_count - last_count >= 20"


@query(
    "SELECT event_id, last_score, coalesce(last_score - privacy_score >= 10, false) AS score_fell,"
    " coalesce(tracker_count - last_count >= 20, false) AS trackers_rose"
    f" FROM {_PREVIOUS} WHERE {_CHANGED}",
    "hist",
)
def change_alerts(spark, sf):
    return trends.change_alerts(site_history(spark, sf)).select(
        "event_id", long("previous.privacy_score", "last_score"), "score_fell", "trackers_rose"
    )


@query(SQL["change_alerts"])
def bucketed_change_alerts(spark, sf):
    """The same from a history table in buckets by url and hour, appended twice."""
    name = f"history_{uuid.uuid4().hex}"
    path = f"{streams.shared_folder(spark, 'bucketed-history')}/table"
    rows = site_history(spark, sf)
    early = F.col("scan_ts") < F.lit(_SPLIT).cast("timestamp")
    for part in (rows.filter(early), rows.filter(~F.coalesce(early, F.lit(False)))):
        history.append_bucketed(part, name, path, buckets=8)
    return trends.change_alerts(spark.table(name), part=history.PART).select(
        "event_id", long("previous.privacy_score", "last_score"), "score_fell", "trackers_rose"
    )


@query(
    "SELECT event_id FROM (SELECT *, last_score - privacy_score AS d, tracker_count - last_count AS r"
    f" FROM {_PREVIOUS}) WHERE (last_score <> 0 AND d * 100.0 / last_score >= 30)"
    " OR (last_count <> 0 AND r * 100.0 / last_count >= 200)",
    "hist",
)
def change_alerts_percent(spark, sf):
    return trends.change_alerts(
        site_history(spark, sf), score_drop=30, tracker_rise=200, percent=True, unit="week"
    ).select("event_id")


_PER_DAY = (
    "(SELECT CAST(scan_ts AS DATE) AS d, count(*) AS pages, CAST(sum(total) AS BIGINT) AS trackers,"
    " avg(score) AS mean_score FROM scored WHERE error IS NULL GROUP BY 1)"
)
_DOMAINS_PER_DAY = (
    f"(SELECT CAST({TS} AS DATE) AS d, count(DISTINCT domain) AS domains FROM pd GROUP BY 1)"
)
_DAILY = (
    "(SELECT a.d, pages, trackers, mean_score, coalesce(domains, 0) AS domains"
    f" FROM {_PER_DAY} a LEFT JOIN {_DOMAINS_PER_DAY} b ON a.d = b.d)"
)


@query(
    "SELECT strftime(d, '%Y-%m-%d') AS day, round(mean_score, 6) AS mean_score, round(mean_score -"
    " lag(mean_score) OVER w, 6) AS score_change, trackers, trackers - lag(trackers) OVER w AS"
    " tracker_change, domains, domains - lag(domains) OVER w AS domain_growth"
    f" FROM {_DAILY} WINDOW w AS (ORDER BY d)",
    "scored", "pd",
)
def daily_trend(spark, sf):
    return trends.trend(trends.daily(scanned(spark, sf))).select(
        day("scan_date").alias("day"),
        F.round("mean_score", 6).alias("mean_score"),
        F.round("score_change", 6).alias("score_change"),
        "trackers",
        "tracker_change",
        "domains",
        "domain_growth",
    )


@query(
    "SELECT strftime(d, '%Y-%m-%d') AS day, round(base, 6) AS baseline, CASE WHEN base IS NULL THEN"
    " 'unknown' WHEN mean_score - base > 0.5 THEN 'improving' WHEN mean_score - base < -0.5 THEN"
    " 'degrading' ELSE 'stable' END AS trending FROM (SELECT *, sum(mean_score * pages) OVER w /"
    f" sum(pages) OVER w AS base FROM {_DAILY} WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED"
    " PRECEDING AND 1 PRECEDING))",
    "scored", "pd",
)
def score_trending(spark, sf):
    return trends.trending(trends.daily(scanned(spark, sf)), 0.5).select(
        day("scan_date").alias("day"), F.round("baseline", 6).alias("baseline"), "trending"
    )


@query(
    "SELECT strftime(a.w, '%Y-%m-%d') AS week, pages, trackers, mean_score, low, medium, high,"
    " coalesce(domains, 0) AS domains FROM (SELECT date_trunc('week', scan_ts) AS w, count(*) AS pages,"
    " CAST(sum(total) AS BIGINT) AS trackers, round(avg(score), 6) AS mean_score,"
    " count(*) FILTER (risk = 'Low') AS low, count(*) FILTER (risk = 'Medium') AS medium,"
    " count(*) FILTER (risk = 'High') AS high FROM scored WHERE error IS NULL GROUP BY 1) a LEFT JOIN"
    f" (SELECT date_trunc('week', {TS}) AS w, count(DISTINCT domain) AS domains FROM pd GROUP BY 1) b"
    " ON a.w = b.w",
    "scored", "pd",
)
def weekly_summary(spark, sf):
    return trends.weekly(scanned(spark, sf)).select(
        day("week").alias("week"),
        "pages",
        "trackers",
        F.round("mean_score", 6).alias("mean_score"),
        "low",
        "medium",
        "high",
        "domains",
    )


_WITHIN = 0.03


@query(
    f"SELECT *, domains AS exact_domains, pages AS exact_urls, true AS domains_close, true AS urls_close"
    f" FROM ({SQL['weekly_summary']})".replace("SELECT *,", "SELECT * EXCLUDE (domains),", 1)
)
def weekly_rollup(spark, sf):
    """Weeks out of daily sketches, with the estimates held against exact counts."""
    parts = _batches_of(spark, sf, "weekly", rollups.daily_parts, rollups.merge_daily)
    exact = trends.weekly(scanned(spark, sf)).select(
        "week", F.col("domains").alias("exact_domains"), F.col("pages").alias("exact_urls")
    )

    def close(estimate: str, exact_count: str):
        return F.abs(F.col(estimate) - F.col(exact_count)) <= _WITHIN * F.col(exact_count)

    return (
        rollups.per_period(parts, "week")
        .join(exact, "week")
        .select(
            day("week").alias("week"),
            "pages",
            "trackers",
            F.round("mean_score", 6).alias("mean_score"),
            "low",
            "medium",
            "high",
            "exact_domains",
            "exact_urls",
            close("domains", "exact_domains").alias("domains_close"),
            close("urls", "exact_urls").alias("urls_close"),
        )
    )


_SPLIT = "2024-01-20 00:00:00"


@query(
    "SELECT c.url, round(c.s, 6) AS current_score, round(b.s, 6) AS baseline_score, round(c.s - b.s, 6)"
    " AS score_change, round(c.t - b.t, 6) AS tracker_change FROM (SELECT url, avg(privacy_score) AS s,"
    f" avg(tracker_count) AS t FROM hist WHERE scan_ts >= TIMESTAMP '{_SPLIT}' GROUP BY url) c"
    " LEFT JOIN (SELECT url, avg(privacy_score) AS s, avg(tracker_count) AS t FROM hist"
    f" WHERE scan_ts < TIMESTAMP '{_SPLIT}' GROUP BY url) b ON c.url = b.url",
    "hist",
)
def baseline_change(spark, sf):
    rows = site_history(spark, sf)
    split = F.lit(_SPLIT).cast("timestamp")
    compared = trends.against_baseline(
        rows.filter(F.col("scan_ts") >= split), rows.filter(F.col("scan_ts") < split)
    )
    return compared.select(
        "url",
        *[
            F.round(n, 6).alias(n)
            for n in ("current_score", "baseline_score", "score_change", "tracker_change")
        ],
    )


@query(
    "SELECT event_id, round((value - m) / s, 6) AS z_score FROM (SELECT *, avg(value) OVER w AS m,"
    " stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type))"
    " WHERE (value - m) / s > 2"
)
def metric_anomalies(spark, sf):
    return (
        anomaly.zscores(load(spark, sf, "events"), "event_type", "value")
        .filter("is_anomaly")
        .select("event_id", F.round("z_score", 6).alias("z_score"))
    )


@query(
    "SELECT event_id, (SELECT bool_or(v - m > 2 * s) FROM (SELECT v, avg(v) OVER () AS m,"
    " stddev_pop(v) OVER () AS s FROM (SELECT unnest([value, k, 1.0, 2.0, 3.0, 2.0, 1.0]) AS v)))"
    " AS is_anomaly FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"
)
def scan_anomalies(spark, sf):
    """The test over the metrics of a single scan."""
    k = F.get_json_object("props", "$.k").cast("double")
    metrics = F.array(F.col("value"), k, *[F.lit(float(v)) for v in (1, 2, 3, 2, 1)])
    return load(spark, sf, "events").select(
        "event_id", anomaly.scan_anomaly(metrics).alias("is_anomaly")
    )


_LATEST_PATTERNS = (
    "SELECT 'u' || user_id AS domain, arg_max(event_type, ts) AS category, strftime(max(ts),"
    " '%Y-%m-%d %H:%M:%S') AS updated_at, 'p' || arg_max(event_id, ts) || ',q' AS patterns"
    " FROM events GROUP BY user_id"
)


@query(_LATEST_PATTERNS)
def latest_patterns(spark, sf):
    """The newest row per host of a pattern table made from the events."""
    return _patterns(_pattern_rows(spark, sf))


@query(_LATEST_PATTERNS)
def stored_patterns(spark, sf):
    """The same from a stored table that four upserts have made, one of them a repeat."""
    path = streams.shared_folder(spark, "patterns")
    rows, third = _pattern_rows(spark, sf), F.pmod(F.crc32("patterns"), F.lit(3))
    for part in (1, 0, 1, 2):
        catalog_files.upsert_patterns(rows.filter(third == part), path)
    return _patterns(catalog_files.read_patterns(spark, path))


def _pattern_rows(spark, sf):
    return load(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id").alias("domain"),
        F.col("event_type").alias("category"),
        F.concat(F.lit('["p'), "event_id", F.lit('","q"]')).alias("patterns"),
        F.col("ts").alias("last_updated"),
    )


def _patterns(table):
    return catalog_files.latest_patterns(table).select(
        "domain",
        "category",
        F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
        joined("patterns", "patterns"),
    )


# --- security ------------------------------------------------------------------------------

# A header is on the pages whose number its step divides.
_STEPS = [
    ("Strict-Transport-Security", 2),
    ("x-content-type-options", 3),
    ("X-Frame-Options", 4),
    ("X-XSS-Protection", 5),
    ("Referrer-Policy", 6),
    ("Permissions-Policy", 7),
    ("Content-Security-Policy", 8),
]


def _with_headers(pages: DataFrame) -> DataFrame:
    entries = F.array(
        *[
            F.when(
                F.col("page_id") % step == 0,
                F.struct(F.lit(name).alias("key"), F.lit("a; b").alias("value")),
            )
            for name, step in _STEPS
        ]
    )
    return pages.withColumn("headers", F.map_from_entries(F.array_compact(entries)))


_RULES = ", ".join(
    f"({i}, {text(n)}, {text(level)}, {text(f'Add {n} header: {reason}')}, {step})"
    for i, ((n, level, reason), (_, step)) in enumerate(zip(security.HEADER_RULES, _STEPS))
)
_CHECKS = f"(SELECT * FROM pages, (VALUES {_RULES}) r(ord, name, level, advice, step))"


@query(
    "SELECT page_id, name, page_id % step = 0 AS present, CASE WHEN page_id % step = 0 THEN 'a; b' END"
    f" AS value, CASE WHEN page_id % step <> 0 THEN level END AS security_level FROM {_CHECKS}"
)
def security_headers(spark, sf):
    return (
        security.audit(_with_headers(load(spark, sf, "pages")))
        .select("page_id", F.inline("security_headers"))
        .select("page_id", "name", "present", "value", "security_level")
    )


@query(
    "SELECT page_id, page_id % 8 = 0 AS present, CASE WHEN page_id % 8 = 0 THEN 'a,b' ELSE '' END AS"
    " directives, CAST(CASE WHEN page_id % 8 <> 0 THEN 0 END AS BIGINT) AS score, CASE WHEN page_id % 8 = 0"
    " THEN '' ELSE 'No Content Security Policy found' END AS violations FROM pages"
)
def content_policy(spark, sf):
    return security.audit(_with_headers(load(spark, sf, "pages"))).select(
        "page_id",
        "csp_analysis.present",
        joined("csp_analysis.directives", "directives"),
        long("csp_analysis.security_score", "score"),
        joined("csp_analysis.violations", "violations"),
    )


@query(
    "SELECT page_id, concat_ws('|', CASE WHEN page_id % 8 <> 0 THEN 'Implement Content Security Policy to"
    " prevent XSS attacks|Start with CSP in report-only mode for testing' END,"
    " string_agg(advice, '|' ORDER BY ord) FILTER (page_id % step <> 0)) AS advice"
    f" FROM {_CHECKS} GROUP BY page_id"
)
def security_advice(spark, sf):
    return security.audit(_with_headers(load(spark, sf, "pages"))).select(
        "page_id", F.array_join("recommendations", "|").alias("advice")
    )


@query(
    "SELECT page_id, tag, a_src AS src FROM ev WHERE NOT ns AND starts_with(lower(a_src), 'http://')"
    " AND starts_with(lower(url), 'https://')",
    "ev",
)
def mixed_content(spark, sf):
    return security.mixed_content(pages_of(spark, sf)).select("page_id", "tag", "src")


@query(
    "SELECT page_id, CAST(floor(epoch(valid_to - TIMESTAMP '2024-01-06 12:00:00') / 86400) AS BIGINT)"
    " AS days_until_expiry, valid_to < TIMESTAMP '2024-01-06 12:00:00' AS is_expired"
    f" FROM (SELECT page_id, {TS} AS valid_to FROM pages)"
)
def certificate_expiry(spark, sf):
    certs = load(spark, sf, "pages").select("page_id", F.expr(SCAN_TS).alias("valid_to"))
    return security.certificates(certs, F.lit("2024-01-06 12:00:00").cast("timestamp")).select(
        "page_id", long("days_until_expiry"), "is_expired"
    )


@query(
    "SELECT count(*) AS total_urls, round(avg(page_id % 101), 6) AS average_security_score,"
    " count(*) FILTER (page_id % 101 > 80) AS secure_sites,"
    " count(*) FILTER (starts_with(lower(url), 'https://')) AS https_adoption FROM pages"
)
def security_summary(spark, sf):
    """The batch summary; the score itself is an input column."""
    score = F.col("page_id") % 101
    audited = load(spark, sf, "pages").select(
        score.alias("overall_security_score"),
        F.when(score > 80, "secure").otherwise("vulnerable").alias("security_level"),
        urls.is_https(F.col("url")).alias("https_enabled"),
    )
    return security.summary(audited).withColumn(
        "average_security_score", F.round("average_security_score", 6)
    )


@query(
    "SELECT d.domain, 'r' || length(i.domain) AS registrar, CASE WHEN i.domain IS NULL THEN 'no record' END"
    f" AS error FROM (SELECT DISTINCT {host('url')} AS domain FROM req) d LEFT JOIN"
    f" (SELECT DISTINCT {host('url')} AS domain FROM pages) i ON d.domain = i.domain",
    "req",
)
def domain_enrichment(spark, sf):
    """Hosts of the request log with their record; only hosts of pages have one."""
    info = (
        load(spark, sf, "pages")
        .select(urls.netloc(F.col("url")).alias("domain"))
        .distinct()
        .select("domain", F.concat(F.lit("r"), F.length("domain")).alias("registrar"))
    )
    log = requests_of_pages(pages_of(spark, sf))
    return enrich.domain_analysis(log, info).select("domain", "registrar", "error")


# --- streams -------------------------------------------------------------------------------


def _event_stream(spark, sf) -> DataFrame:
    schema = load(spark, sf, "events").schema
    return history_of(spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*"))


@query(
    "SELECT page_id, url, CASE WHEN error IS NULL THEN score END AS privacy_score, total AS"
    " total_trackers, error FROM scored",
    "scored",
)
def stream_scan(spark, sf):
    """The basic scan on a stream of page files."""
    pages = web_pages(streams.page_stream(spark, f"{sf}/pages.parquet*"))
    stream = scan(pages, scan_ts=F.expr(SCAN_TS), with_source=False).select(
        "page_id",
        "url",
        long("privacy_analysis.privacy_score"),
        long("summary.total_trackers"),
        "error",
    )
    return streams.run_to_table(stream, streams.shared_folder(spark, "stream-scan"))


def _windows(unit: str, days: int) -> str:
    return (
        f"SELECT strftime(w, '%Y-%m-%d') AS window_start, count(*) AS scans, CAST(sum(tracker_count) AS"
        f" BIGINT) AS trackers, round(avg(privacy_score), 6) AS mean_score FROM (SELECT *,"
        f" date_trunc('{unit}', scan_ts) AS w FROM hist) WHERE w + INTERVAL {days} DAY <="
        " (SELECT max(scan_ts) FROM hist) - INTERVAL 1 DAY GROUP BY w"
    )


def _window_rows(stream: DataFrame, spark, name: str) -> DataFrame:
    table = streams.run_to_table(stream, streams.shared_folder(spark, name))
    return table.select(
        day("window_start").alias("window_start"),
        "scans",
        "trackers",
        F.round("mean_score", 6).alias("mean_score"),
    )


@query(_windows("day", 1), "hist")
def stream_daily(spark, sf):
    """Daily windows the watermark has closed."""
    return _window_rows(streams.daily_counts(_event_stream(spark, sf)), spark, "stream-daily")


_WEEKS = _windows("week", 7).replace(
    " FROM (SELECT *,", ", count(DISTINCT url) AS exact_urls, true AS urls_close FROM (SELECT *,", 1
)


@query(_WEEKS, "hist")
def stream_weekly(spark, sf):
    """Weekly windows, with the estimated number of urls held against the exact one."""
    stream = streams.weekly_counts(_event_stream(spark, sf))
    table = streams.run_to_table(stream, streams.shared_folder(spark, "stream-weekly"))
    exact = (
        site_history(spark, sf)
        .groupBy(F.date_trunc("week", "scan_ts").alias("window_start"))
        .agg(F.count_distinct("url").alias("exact_urls"))
    )
    close = F.abs(F.col("distinct_urls") - F.col("exact_urls")) <= 0.15 * F.col("exact_urls")
    return table.join(exact, "window_start").select(
        day("window_start").alias("window_start"),
        "scans",
        "trackers",
        F.round("mean_score", 6).alias("mean_score"),
        "exact_urls",
        close.alias("urls_close"),
    )


@query(SQL["scan_statistics"])
def stream_rollup(spark, sf):
    """Statistics out of the rollups that a stream of scans keeps."""
    folder = streams.shared_folder(spark, "stream-rollup")
    pages = web_pages(streams.page_stream(spark, f"{sf}/pages.parquet*"))
    stream = scan(pages, scan_ts=F.expr(SCAN_TS), with_source=False)
    writer = streams.rollup_writer(stream, f"{folder}/rollup")
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True
    ).start().awaitTermination()
    return rollups.statistics(rollups.stored(spark, f"{folder}/rollup")).withColumn(
        "mean_score", F.round("mean_score", 6)
    )


@query(
    "SELECT DISTINCT url, tracker_count, privacy_score FROM hist", "hist"
)
def stream_dedupe(spark, sf):
    """Repeated outcomes of a site dropped; the bound covers the whole month."""
    stream = streams.drop_repeats(_event_stream(spark, sf), "60 days")
    table = streams.run_to_table(stream, streams.shared_folder(spark, "stream-dedupe"))
    return table.select("url", long("tracker_count"), long("privacy_score"))


@query(_LEVEL, "hist")
def stream_level_alerts(spark, sf):
    stream = streams.alert_stream(_event_stream(spark, sf)).select(
        "event_id", joined("reasons", "reasons")
    )
    return streams.run_to_table(stream, streams.shared_folder(spark, "stream-alerts"))


@query(
    "SELECT url, strftime(scan_ts, '%Y-%m-%d %H:%M:%S') AS scanned_at, last_score"
    f" FROM {_PREVIOUS} WHERE {_CHANGED}",
    "hist",
)
def stream_change_alerts(spark, sf):
    """Alerts over three batches: a third of the events is written, then the stream takes it.

    Two days come late, one of them in the last batch."""
    folder = streams.shared_folder(spark, "stream-changes")
    events = load(spark, sf, "events")
    days = F.dayofmonth(F.col("ts").cast("timestamp"))
    batch = F.when(days.isin(4, 15), 2).when(days == 7, 1).otherwise(F.least(F.floor((days - 1) / 10), F.lit(2)))
    for part in range(3):
        events.filter(batch == part).write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
        writer = streams.change_alert_writer(
            history_of(stream), f"{folder}/alerts", f"{folder}/state", lateness_days=40
        )
        writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(
            availableNow=True
        ).start().awaitTermination()
    return streams.change_alerts_of(spark, f"{folder}/alerts").select(
        "url",
        F.date_format("scan_ts", "yyyy-MM-dd HH:mm:ss").alias("scanned_at"),
        long("previous.privacy_score", "last_score"),
    )


@query(
    "SELECT strftime(scan_ts, '%Y-%m-%d') AS day, count(*) AS scans, CAST(sum(tracker_count) AS BIGINT)"
    " AS trackers FROM hist GROUP BY 1",
    "hist",
)
def stream_history(spark, sf):
    """History appended from a stream, counted by day."""
    folder = streams.shared_folder(spark, "stream-history")
    rows = _event_stream(spark, sf).select(
        "url", "scan_ts", "tracker_count", "privacy_score", "result_hash", "scan_date"
    )
    streams.history_writer(rows, f"{folder}/table", f"{folder}/checkpoint").trigger(
        availableNow=True
    ).start().awaitTermination()
    return (
        history.read(spark, f"{folder}/table")
        .groupBy(day("scan_date").alias("day"))
        .agg(F.count("*").alias("scans"), F.sum("tracker_count").alias("trackers"))
    )


# --- clusters ------------------------------------------------------------------------------


@query()
def host_clusters(spark, sf):
    """Hosts of the request log grouped by spelling; no SQL form."""
    log = requests_of_pages(pages_of(spark, sf))
    return cluster.cluster_domains(log.select(urls.netloc(F.col("url")).alias("domain")))


@query(
    f"SELECT DISTINCT {host('url')} AS domain, true AS has_cluster FROM req WHERE {host('url')} <> ''",
    "req",
)
def clustered_hosts(spark, sf):
    """What is determined of the clusters: each host is in one, numbered from 0."""
    return host_clusters(spark, sf).select(
        "domain", F.col("cluster").between(0, 4).alias("has_cluster")
    )


@query(
    f"SELECT DISTINCT {host('url')} AS domain, true AS at_nearest, 5 AS centres FROM req"
    f" WHERE {host('url')} <> ''",
    "req",
)
def nearest_clusters(spark, sf):
    """Each host is at the nearest of the centres, by distances worked out apart from the model."""
    log = requests_of_pages(pages_of(spark, sf))
    found = cluster.fit(log.select(urls.netloc(F.col("url")).alias("domain")))
    apart = cluster.distances(F.col("features"), found.centres)
    own = F.get("apart", "cluster")
    return found.hosts.withColumn("apart", apart).select(
        "domain",
        (own <= F.array_min("apart") + 1e-9).alias("at_nearest"),
        F.lit(len(found.centres)).alias("centres"),
    )
