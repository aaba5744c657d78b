"""Matching against Python's own regular expressions."""

import re

import pytest
from pyspark.sql import functions as F

from trackscan import fixed_values as fixed
from trackscan.functions import match
from trackscan.operators import scripts

TEXTS = [
    "",
    "GA('x') gtag(\n) FBQ(1)",
    "ga( \n) dataLayer.push hotjar HJ(",
    "ſentry Kissmetrics linkedİn lınkedin",
    "xs.t( s.tl( _fbq. facebook.com/tr connect.facebook.net",
    "facebook.comfacebook.com/trfacebook.net",
    "saturn.com ttq.track('AddToCart') ttq.track ( \"CompletePayment\" ) tr.snapchat.com",
    'getContext("2d") getcontext( \'2d\') measureText canvas.toDataURL',
    "mixpanel.track mixpanel.tracker api.mixpanel.com mp_track2o7.net",
    "crazyegg dnn506yrbagrg.cloudfront.net crazyegg.com optimizely.com optly",
    "conversion.js conversion config init send event",
    'gtag ( "conversion" gtag("event" ga("send"',
]


def hits(spark, patterns):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    found = df.select("t", match.texts_found(match.fold(F.col("t")), match.needed_texts(patterns)).alias("f"))
    rows = found.select("t", match.pattern_hits(patterns, F.col("t"), F.col("f")).alias("h")).collect()
    return {r.t: r.h for r in rows}


def expected(patterns):
    return {t: [p for p in patterns if re.search(p, t, re.IGNORECASE)] for t in TEXTS}


def test_script_patterns(spark):
    assert hits(spark, fixed.SCRIPT_PATTERNS) == expected(fixed.SCRIPT_PATTERNS)


def test_catalogue_patterns(spark):
    patterns = [p for row in fixed.CATALOGUE for p in row[4]]
    assert hits(spark, patterns) == expected(patterns)


def test_user_patterns(spark):
    patterns = ["a|b", r"t\w+g", "(ab)?", "^GA", "x{0}", "net$", r"\bsend\b", "[0-9]", "k.ss"]
    assert hits(spark, patterns) == expected(patterns)


def test_first_domain(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select("t", match.first_domain(F.col("t")).alias("d")).collect()
    for r in rows:
        assert r.d == next((d for d in fixed.TRACKER_DOMAINS if d in r.t), None)


def test_any_of_finds_overlapping_texts(spark):
    texts = [f"w{i}" for i in range(20)] + ["abc", "ab", "bcd", "abcde"]
    df = spark.createDataFrame([("xabcdew1w12",), ("ab",), ("",)], "t string")
    found = [set(r[0]) for r in df.select(match.texts_found(F.col("t"), texts)).collect()]
    assert found == [{"abcde", "bcd", "w1", "w12"}, {"ab"}, set()]


def test_plain_and_required_text():
    assert match.plain_text(r"gtm\.") == "gtm."
    assert match.plain_text(r"a\d") is None
    assert match.required_text(r"ga\s*\(\s*[\"\']send") == "send"
    assert match.required_text(r"\x41bc") is None
    assert match.required_text("a|b") is None
    assert match.required_text("ab?") is None


def test_pattern_table(spark):
    patterns = [("a", r"track\("), ("b", r"track\("), ("b", r"send\w*"), ("c", "none")]
    bodies = spark.createDataFrame([(1, 0, "Track( SENDER"), (2, 0, "x")], "page_id int, pos int, body string")
    table = spark.createDataFrame(patterns, "family string, pattern string")
    rows = scripts.join_patterns(bodies, table).collect()
    assert sorted((r.page_id, r.family, r.pattern) for r in rows) == sorted((1, *p) for p in patterns[:3])


def test_pattern_table_of_any_size(spark):
    patterns = [("f", f"needle{i}x") for i in range(20_000)] + [("n", None), ("e", ""), ("s", "ab"), ("r", r"call\w+\(")]
    patterns += [("f", "needle7x")]  # a repeated row counts twice
    texts = ["", None, "NEEDLE7x", "callMe( needle19999x", "xab" * 9000 + "needle1x", "callMe( needle19999x"]
    bodies = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "page_id int, body string, text_key string")
    found = scripts.join_patterns(bodies, spark.createDataFrame(patterns, "family string, pattern string"))
    assert found.columns == ["page_id", "body", "text_key", "family", "pattern"]
    got = sorted((r.page_id, r.family, r.pattern) for r in found.collect())
    want = [
        (i, f, p) for i, t in enumerate(texts) for f, p in patterns
        if t is not None and p is not None and re.search(p, t, re.I)
    ]
    assert got == sorted(want) and len(want) == 13
    assert scripts.join_patterns(bodies.limit(0), spark.createDataFrame([], "family string, pattern string")).count() == 0
