"""Scan results as files: JSON sinks and source, and the flat export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXEL = (
    "struct<element_type:string,src:string,width:string,height:string,is_1x1_pixel:boolean,"
    "tracking_domain:string,has_tracking_params:boolean,in_noscript:boolean,"
    "is_base64:boolean,tracking_type:string,full_element:string>"
)
SCRIPT = (
    "struct<type:string,domain:string,src:string,element:string,pattern:string,"
    "content_snippet:string>"
)
META = "struct<type:string,name:string,property:string,content:string,element:string>"
CSS = "struct<type:string,url:string,domain:string,element:string>"
SUMMARY = (
    "struct<total_trackers:int,domains_found:array<string>,"
    "tracking_types:struct<pixels:int,javascript:int,meta_tags:int,css_background:int>>"
)
ANALYSIS = (
    "struct<privacy_score:int,risk_level:string,detected_categories:array<string>,"
    "high_risk_domains:array<string>,recommendations:array<string>>"
)
RESULT_SCHEMA = (
    "page_id bigint, url string, error string, scan_timestamp timestamp, pixel_count int,"
    " js_tracker_count int, meta_tracker_count int, css_tracker_count int,"
    f" tracking_pixels array<{PIXEL}>, javascript_trackers array<{SCRIPT}>,"
    f" meta_trackers array<{META}>, css_trackers array<{CSS}>, summary {SUMMARY},"
    f" privacy_analysis {ANALYSIS}"
)


def write_json(scanned: DataFrame, path: str) -> None:
    """Basic results, one JSON object per line."""
    scanned.drop("domains").write.mode("overwrite").json(path)


def write_enhanced_json(scanned: DataFrame, path: str) -> None:
    """Enhanced results, one JSON object per line; times become text."""
    scanned.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, one_document: bool = False) -> DataFrame:
    """Basic results back from JSON; fields an older file lacks are null.

    `one_document` is for recorded files that hold a single array. Such a file is read by one
    task, so results this package writes use a line per page.
    """
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", one_document).json(path)


def export_rows(scanned: DataFrame) -> DataFrame:
    """One flat row per page and detection."""
    none = F.lit(None).cast("string")

    def row(family, kind, domain, detail):
        return F.struct(
            F.lit(family).alias("family"),
            kind.alias("type"),
            domain.alias("domain"),
            detail.alias("detail"),
        )

    rows = F.concat(
        F.transform(
            "tracking_pixels",
            lambda p: row("pixel", p["element_type"], p["tracking_domain"], p["src"]),
        ),
        F.transform(
            "javascript_trackers",
            lambda s: row("javascript", s["type"], s["domain"], F.coalesce(s["src"], s["pattern"])),
        ),
        F.transform(
            "meta_trackers",
            lambda m: row("meta", m["type"], none, F.coalesce(m["name"], m["property"])),
        ),
        F.transform("css_trackers", lambda c: row("css", c["type"], c["domain"], c["url"])),
    )
    return scanned.select(
        "page_id",
        "url",
        "scan_timestamp",
        F.col("privacy_analysis.privacy_score").alias("privacy_score"),
        F.col("privacy_analysis.risk_level").alias("risk_level"),
        F.inline(rows),
    )


EXPORT_SCHEMA = (
    "page_id bigint, url string, scan_timestamp timestamp, privacy_score int, risk_level string,"
    " family string, type string, domain string, detail string"
)
# Texts may hold quotes, line ends and nothing at all; a null is told from an empty text.
_CSV = {"header": True, "quoteAll": True, "escape": '"', "multiLine": True, "nullValue": "\\N"}


def export_csv(scanned: DataFrame, path: str) -> None:
    export_rows(scanned).write.mode("overwrite").options(**_CSV).csv(path)


def read_export_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPORT_SCHEMA).options(**_CSV).csv(path)


def export_parquet(scanned: DataFrame, path: str) -> None:
    export_rows(scanned).write.mode("overwrite").parquet(path)
