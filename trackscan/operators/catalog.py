"""The tracker catalogue: detection in page text, lookup, filters and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.fixed_values import CATALOGUE
from trackscan.functions.match import (
    RULE,
    fold,
    needed_texts,
    pattern_rows,
    rule_holds,
    rules,
    texts_found,
)
from trackscan.functions.rule_index import matches
from trackscan.functions.tables import chunks
from trackscan.functions.text import title
from trackscan.sources.seeds import catalogue

REGEX, DOMAIN = "regex_match", "domain_match"
HIGH_RISK = ("high", "critical")
ATTRIBUTES = (
    "name",
    "category",
    "risk_level",
    "description",
    "data_types",
    "gdpr_relevant",
    "ccpa_relevant",
    "evasion_techniques",
)


def _rules(trackers: Sequence[tuple]) -> tuple[list[dict], list[str], list[str]]:
    """Rules of all trackers, patterns of a tracker before its hosts; patterns; texts to find."""
    patterns = [p for t in trackers for p in t[4] or ()]
    texts = sorted({*needed_texts(patterns), *(d.lower() for t in trackers for d in t[5] or ())})
    rows = []
    for t in trackers:
        for row in pattern_rows(t[4] or (), texts):
            rows.append({**row, "tracker_id": t[0], "type": REGEX})
        for host in t[5] or ():
            needs = [x for x in texts if x.startswith(host.lower())]
            rows.append(
                {"pattern": host, "needs": needs, "plain": True, "tracker_id": t[0], "type": DOMAIN}
            )
    return rows, patterns, texts


def detect_in_pages(pages: DataFrame, trackers: Sequence[tuple] = CATALOGUE) -> DataFrame:
    """One row per page and tracker with any match, its matches nested in catalogue order.

    The whole match runs in the row of the page, for any number of rules: trackers go in chunks,
    each of which is one constant expression with one search of the text. Page text is in no join
    or shuffle; only the few matched rows meet the tracker attributes, a list that is part of the
    program and so safe to broadcast. Pages that repeat a page_id, or have none, stay apart.
    """
    attributes = catalogue(pages.sparkSession, trackers).select("tracker_id", *ATTRIBUTES)
    sizes = [len(t[4] or ()) + len(t[5] or ()) for t in trackers]
    parts = [_rules(some) for some in chunks(trackers, sizes)]
    html, url = F.col("html"), F.col("url")

    def hits(number: int) -> Column:
        rows, patterns, _ = parts[number]
        found = F.col(f"_found_{number}")

        def holds(rule: Column) -> Column:
            # Hosts count only in the case in which they are listed, patterns in any.
            inside = F.arrays_overlap(found, rule["needs"]) & html.contains(rule["pattern"])
            host = inside | url.contains(rule["pattern"])
            return F.when(rule["type"] == DOMAIN, host).otherwise(
                rule_holds(rule, patterns, html, found)
            )

        return F.filter(rules(rows, f"{RULE},tracker_id:string,type:string"), holds)

    def nested(tracker_id: Column) -> Column:
        mine = F.filter(F.col("_hits"), lambda h: h["tracker_id"] == tracker_id)
        return F.struct(
            tracker_id.alias("tracker_id"),
            F.transform(
                mine, lambda h: F.struct(h["pattern"].alias("pattern"), h["type"].alias("type"))
            ).alias("matches"),
        )

    # A failed page is not searched, not even its address.
    searched = pages.filter(F.length("html") > 0).select(
        "page_id",
        "url",
        "html",
        *(texts_found(fold(html), p[2]).alias(f"_found_{i}") for i, p in enumerate(parts)),
    )
    empty = rules([], f"{RULE},tracker_id:string,type:string")
    found = searched.select(
        "page_id", F.concat(empty, *(hits(i) for i in range(len(parts)))).alias("_hits")
    )
    hit_ids = F.array_distinct(F.transform("_hits", lambda h: h["tracker_id"]))
    return (
        found.select("page_id", F.inline(F.transform(hit_ids, nested)))
        .join(F.broadcast(attributes), "tracker_id")
        .select("page_id", "tracker_id", *ATTRIBUTES, "matches")
    )


def detect_with_table(pages: DataFrame, trackers: DataFrame) -> DataFrame:
    """The same detection against a catalogue known only at run time, of any size.

    The rules stay a table: they are found through an index of their texts (see rule_index), and
    what a page holds is put together from the rules that it met. Null lists of patterns or hosts
    are empty ones. Equal rows of pages are searched once and each get the findings.
    """
    listed = ("patterns", REGEX), ("domains", DOMAIN)
    rows = reduce(
        DataFrame.union,
        (
            trackers.select("tracker_id", "ord", F.posexplode(column).alias("pos", "pattern"), F.lit(i).alias("kind"))
            for i, (column, _) in enumerate(listed)
        ),
    )
    rules = rows.withColumn("rule", F.concat_ws("/", "kind", "pos", "ord", "tracker_id"))
    is_host = (F.col("kind") == 1).alias("is_host")
    searched = pages.filter(F.length("html") > 0).withColumn(
        "text_key", F.md5(F.to_json(F.struct("page_id", "url", "html")))
    )
    times = searched.groupBy("text_key", "page_id").agg(F.count("*").cast("int").alias("times"))
    plain = rules.select("rule", "pattern", is_host)
    hits = matches(searched.select("text_key", F.col("html").alias("text")).distinct(), plain).union(
        matches(searched.select("text_key", F.col("url").alias("text")).distinct(), plain.filter("is_host"))
    )
    kind = F.when(F.col("kind") == 0, listed[0][1]).otherwise(listed[1][1])
    match = F.struct("ord", "kind", "pos", "pattern", kind.alias("type"))
    return (
        hits.distinct()
        .join(rules, "rule")
        .groupBy("text_key", "tracker_id")
        .agg(F.array_sort(F.collect_list(match)).alias("found"))
        .join(times, "text_key")
        .join(trackers.select("tracker_id", *ATTRIBUTES), "tracker_id")
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
        .select(
            "page_id",
            "tracker_id",
            *ATTRIBUTES,
            F.transform("found", lambda m: F.struct(m["pattern"], m["type"])).alias("matches"),
        )
    )


def by_category(trackers: DataFrame, category: str) -> DataFrame:
    return trackers.filter(F.col("category") == category)


def high_risk(trackers: DataFrame) -> DataFrame:
    return trackers.filter(F.col("risk_level").isin(*HIGH_RISK))


def lookup(rows: DataFrame, trackers: DataFrame) -> DataFrame:
    """Rows with a `domain` and the tracker that lists it, null if none does.

    Of several trackers that list a domain the first in catalogue order counts. The listed domains
    are dealt out anew for the join, so that adaptive execution can split a domain that many rows
    have; below an aggregate that is dealt out by the same key it can not.
    """
    first = (
        trackers.select("tracker_id", "ord", F.explode("domains").alias("domain"))
        .groupBy("domain")
        .agg(F.min_by("tracker_id", "ord").alias("tracker_id"))
    )
    dealt = first.withColumn("domain", F.concat("domain", F.lit("")))
    return rows.join(dealt, "domain", "left")


def _statistic_rows(trackers: DataFrame, listing: bool) -> DataFrame:
    """Totals, counts per group, and on demand the high-risk trackers, in one pass."""
    groups = ["category", "risk_level", "detection_method"]
    keys = [*groups, "name", "tracker_id"]
    sets = [[], *[[g] for g in groups]]
    if listing:
        sets.append(["category", "risk_level", "name", "tracker_id"])

    def row(statistic, value: Column, count: Column) -> Column:
        return F.struct(
            statistic.alias("statistic"), value.alias("value"), count.cast("long").alias("count")
        )

    def is_set(*kept: str) -> Column:
        """Whether a row is of the grouping set of these keys; each lost key is one bit."""
        return F.col("_set") == sum(
            1 << n for n, key in enumerate(reversed(keys)) if key not in kept
        )

    measures = {
        "total_trackers": F.count("*"),
        "total_domains": F.sum(F.size("domains")),
        "total_patterns": F.sum(F.size("patterns")),
        "gdpr_relevant_count": F.count_if("gdpr_relevant"),
        "ccpa_relevant_count": F.count_if("ccpa_relevant"),
    }
    totals = F.array(*[row(F.lit(n), F.lit(""), F.col(n)) for n in measures])
    text = F.concat_ws("", "name", F.lit(" ("), "category", F.lit(") - "), "risk_level")
    rows = F.when(is_set(), totals)
    for g in groups:
        rows = rows.when(is_set(g), F.array(row(F.lit(g), F.col(g), F.col("total_trackers"))))
    risky = F.col("risk_level").isin(*HIGH_RISK)
    rows = rows.when(risky, F.array(row(F.lit("high_risk_tracker"), text, F.lit(1))))
    return (
        trackers.groupingSets(sets, *keys)
        .agg(*[m.alias(n) for n, m in measures.items()], F.grouping_id().alias("_set"))
        .select(F.inline(rows))
    )


def statistics(trackers: DataFrame) -> DataFrame:
    """Totals and counts per category, risk and method as (statistic, value, count) rows."""
    return _statistic_rows(trackers, listing=False)


def summary(trackers: DataFrame) -> DataFrame:
    """The statistics with readable names, and the high-risk trackers, as rows."""
    rows = _statistic_rows(trackers, listing=True)
    readable = F.when(F.col("statistic") == "high_risk_tracker", F.col("value")).otherwise(
        title(F.col("value"))
    )
    return rows.withColumn("value", readable)


def compliance(detected: DataFrame) -> DataFrame:
    """GDPR- and CCPA-relevant detections per page."""
    return detected.groupBy("page_id").agg(
        F.count_if("gdpr_relevant").alias("gdpr_count"),
        F.count_if("ccpa_relevant").alias("ccpa_count"),
        F.count("*").alias("tracker_count"),
    )
