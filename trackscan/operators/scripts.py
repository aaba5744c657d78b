"""Tracker scripts: by source host, and by patterns in the script text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.fixed_values import SCRIPT_PATTERNS, TRACKER_DOMAINS
from trackscan.functions.lex import attribute
from trackscan.functions.match import (
    first_domain,
    fold,
    needed_texts,
    pattern_hits,
    strings,
    texts_found,
)
from trackscan.functions.rule_index import matches
from trackscan.functions.text import cut

SCRIPT_ROW = (
    "struct<type:string,domain:string,src:string,element:string,"
    "pattern:string,content_snippet:string>"
)


def _scripts(elements: Column, patterns: Sequence[str] = ()) -> Column:
    found = F.filter(elements, lambda e: (e["tag"] == "script") & ~e["in_noscript"])
    return F.transform(
        found,
        lambda e: F.struct(
            e["pos"].alias("pos"),
            attribute(e["attrs"], "src").alias("src"),
            e["body"].alias("body"),
            texts_found(fold(e["body"]), needed_texts(patterns)).alias("found"),
            e["source"].alias("source"),
        ),
    )


def scripts(
    elements: Column,
    domains: Sequence[str] = TRACKER_DOMAINS,
    patterns: Sequence[str] = SCRIPT_PATTERNS,
    with_source: bool = True,
) -> Column:
    """Script rows of a page: per script the listed host, then every pattern in its text."""
    none = F.lit(None).cast("string")

    def external(script: Column) -> Column:
        return F.struct(
            F.lit("external_script").alias("type"),
            first_domain(script["src"], domains).alias("domain"),
            script["src"].alias("src"),
            (script["source"] if with_source else none).alias("element"),
            none.alias("pattern"),
            none.alias("content_snippet"),
        )

    def inline(script: Column) -> Column:
        hits = pattern_hits(patterns, script["body"], script["found"])
        return F.transform(
            F.when(script["body"] != "", hits).otherwise(strings([])),
            lambda p: F.struct(
                F.lit("inline_script").alias("type"),
                none.alias("domain"),
                none.alias("src"),
                none.alias("element"),
                p.alias("pattern"),
                cut(script["body"], 200).alias("content_snippet"),
            ),
        )

    def rows(script: Column) -> Column:
        named = F.filter(F.array(external(script)), lambda r: r["domain"].isNotNull())
        return F.concat(named, inline(script))

    return F.flatten(F.transform(_scripts(elements, patterns), rows))


def script_bodies(pages: DataFrame) -> DataFrame:
    """One row per inline script text of pages that carry an `elements` column."""
    return (
        pages.select("page_id", F.explode(_scripts(F.col("elements"))).alias("s"))
        .select("page_id", "s.pos", "s.body")
        .filter(F.col("body") != "")
    )


def join_patterns(bodies: DataFrame, patterns: DataFrame) -> DataFrame:
    """Scripts against a table of user patterns, one row per script and matching pattern.

    The table may have any size: patterns are found through an index of their texts (see
    rule_index) and are neither collected nor broadcast. Copies of a script are one text from the
    first aggregate on, which all searches read; what a text holds comes back to its scripts by the
    digest of the text, so a script's text is in that join only if the caller keeps it. Null
    patterns and null texts match nothing, repeated rows of either table each count.
    """
    key = "text_key"
    while key in bodies.columns or key in patterns.columns:
        key += "_"
    keyed = bodies.withColumn(key, F.md5("body"))
    texts = (
        keyed.filter("body IS NOT NULL")
        .groupBy(F.col(key).alias("text_key"))
        .agg(F.first("body").alias("text"))
    )
    rules = patterns.select("pattern").distinct()
    hits = matches(
        texts, rules.select(F.col("pattern").alias("rule"), "pattern", F.lit(False).alias("is_host"))
    ).distinct()
    rows = hits.select(F.col("text_key").alias(key), F.col("rule").alias("pattern")).join(patterns, "pattern")
    return keyed.join(rows, key).select(*bodies.columns, *patterns.columns)
