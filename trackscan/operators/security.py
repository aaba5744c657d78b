"""Security audit of pages: headers, content policy, mixed content, certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.functions.lex import all_elements, attribute
from trackscan.functions.match import strings
from trackscan.functions.text import days_until
from trackscan.functions.urls import is_https

# Fixed values: (header, level when missing, reason), in report order.
HEADER_RULES = [
    ("Strict-Transport-Security", "vulnerable", "HSTS header enforces HTTPS"),
    ("X-Content-Type-Options", "vulnerable", "Prevents MIME type sniffing"),
    ("X-Frame-Options", "vulnerable", "Prevents clickjacking attacks"),
    ("X-XSS-Protection", "warning", "Legacy XSS protection"),
    ("Referrer-Policy", "vulnerable", "Controls referrer information"),
    ("Permissions-Policy", "warning", "Controls browser features"),
]
CSP = "Content-Security-Policy"
CSP_VIOLATION = "No Content Security Policy found"
CSP_ADVICE = [
    "Implement Content Security Policy to prevent XSS attacks",
    "Start with CSP in report-only mode for testing",
]


def header(headers: Column, name: str) -> Column:
    """A response header whatever the case of its name, else null."""
    same = F.filter(F.map_entries(headers), lambda h: F.lower(h["key"]) == name.lower())
    return F.get(same, F.lit(0))["value"]


def header_checks(headers: Column) -> Column:
    """One struct per required header. A present header has no level: none is defined."""

    def check(name: str, level: str, reason: str) -> Column:
        value = header(headers, name)
        missing = value.isNull()
        return F.struct(
            F.lit(name).alias("name"),
            value.alias("value"),
            (~missing).alias("present"),
            F.when(missing, level).alias("security_level"),
            F.when(missing, strings([f"Add {name} header: {reason}"]))
            .otherwise(strings([]))
            .alias("recommendations"),
        )

    return F.array(*[check(*rule) for rule in HEADER_RULES])


def csp_analysis(headers: Column) -> Column:
    """Content policy of a page. A present policy has no score: none is defined."""
    value = header(headers, CSP)
    missing = value.isNull()
    directives = F.filter(
        F.transform(F.split(value, ";"), lambda d: F.trim(d)), lambda d: d != ""
    )
    return F.struct(
        (~missing).alias("present"),
        F.coalesce(directives, strings([])).alias("directives"),
        F.when(missing, F.lit(0)).alias("security_score"),
        F.when(missing, strings([CSP_VIOLATION])).otherwise(strings([])).alias("violations"),
        F.when(missing, strings(CSP_ADVICE)).otherwise(strings([])).alias("recommendations"),
        (missing & header(headers, f"{CSP}-Report-Only").isNotNull()).alias("report_only"),
    )


def audit(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, headers) with header checks, policy and ordered advice."""
    checked = pages.select(
        "page_id",
        "url",
        is_https(F.col("url")).alias("https_enabled"),
        csp_analysis(F.col("headers")).alias("csp_analysis"),
        header_checks(F.col("headers")).alias("security_headers"),
    )
    advice = F.concat(
        F.col("csp_analysis.recommendations"),
        F.flatten(F.transform("security_headers", lambda h: h["recommendations"])),
    )
    return checked.withColumn("recommendations", advice)


def mixed_content(pages: DataFrame) -> DataFrame:
    """Plain-http sources on https pages, one row per element."""
    sources = F.transform(
        all_elements(F.col("html")),
        lambda e: F.struct(
            e["pos"].alias("pos"), e["tag"].alias("tag"), attribute(e["attrs"], "src").alias("src")
        ),
    )
    # Pages with no such address anywhere are dropped before they are parsed.
    return (
        pages.filter(is_https(F.col("url")) & F.col("html").rlike("(?i)http://"))
        .select("page_id", "url", F.inline(sources))
        .filter(F.startswith(F.lower("src"), F.lit("http://")))
    )


def certificates(certs: DataFrame, as_of: Column) -> DataFrame:
    """Certificates (valid_from, valid_to) with days left and an expired flag."""
    return certs.select(
        "*",
        days_until(F.col("valid_to"), as_of).alias("days_until_expiry"),
        (F.col("valid_to") < as_of).alias("is_expired"),
    )


def summary(results: DataFrame) -> DataFrame:
    """Mean score, secure pages and https pages of a batch."""
    return results.agg(
        F.count("*").alias("total_urls"),
        F.coalesce(F.avg("overall_security_score"), F.lit(0.0)).alias("average_security_score"),
        F.count_if(F.col("security_level") == "secure").alias("secure_sites"),
        F.count_if("https_enabled").alias("https_adoption"),
    )
