"""Catalogue statistics, lookup, detection and files."""

import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from trackscan import fixed_values as fixed
from trackscan.functions import tables
from trackscan.operators import catalog
from trackscan.sources import catalog_files, seeds


def test_statistics(spark):
    rows = catalog.statistics(seeds.catalogue(spark)).collect()
    counts = {(r.statistic, r.value): r["count"] for r in rows}
    assert [
        counts[name, ""]
        for name in (
            "total_trackers",
            "total_domains",
            "total_patterns",
            "gdpr_relevant_count",
            "ccpa_relevant_count",
        )
    ] == [22, 50, 98, 21, 21]
    assert {v: n for (s, v), n in counts.items() if s == "risk_level"} == {
        "medium": 11,
        "high": 8,
        "critical": 2,
        "low": 1,
    }
    assert counts["category", "social_advertising"] == 6
    assert counts["detection_method", "javascript"] == 22


def test_seed_sizes(spark):
    assert seeds.tracker_domains(spark).count() == 135
    assert seeds.tracker_domains(spark).select("domain").distinct().count() == 134
    assert seeds.script_patterns(spark).count() == 79
    assert seeds.category_domains(spark).count() == 32
    assert seeds.verification_meta(spark).count() == 6
    assert seeds.host_intelligence(spark).count() == 9
    assert seeds.pattern_families(spark).count() == 16
    assert [r.ord for r in seeds.first_domains(spark).collect()] == list(range(10))


def test_filters(spark):
    cat = seeds.catalogue(spark)
    assert catalog.by_category(cat, "advertising").count() == 2
    assert catalog.high_risk(cat).count() == 10


def test_lookup_keeps_every_row(spark):
    names = ["hotjar.com"] * 5 + ["", None, "x.y"]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "domain string, id int")
    listed = [("t", 2, ["hotjar.com", "hotjar.com", ""]), ("s", 1, ["hotjar.com", None]), ("u", 0, None)]
    table = spark.createDataFrame(listed, "tracker_id string, ord int, domains array<string>")
    found = {r.id: r.tracker_id for r in catalog.lookup(rows, table).collect()}
    assert found == {**dict.fromkeys(range(5), "s"), 5: "t", 6: None, 7: None}


def test_lookup_takes_the_first_tracker(spark):
    names = ["google-analytics.com", "hotjar.com", "googlesyndication.com", "analytics.tiktok.com"]
    rows = spark.createDataFrame([(n,) for n in names], "domain string")
    found = {r.domain: r.tracker_id for r in catalog.lookup(rows, seeds.catalogue(spark)).collect()}
    assert found == {
        "google-analytics.com": "google_analytics",
        "hotjar.com": None,
        "googlesyndication.com": "google_analytics",
        "analytics.tiktok.com": "tiktok_pixel",
    }


def expected(url, html):
    out = {}
    for t in fixed.CATALOGUE:
        found = [(p, "regex_match") for p in t[4] if re.search(p, html, re.IGNORECASE)]
        found += [(d, "domain_match") for d in t[5] if d in html or d in url]
        if found:
            out[t[0]] = found
    return out


HTMLS = [
    ("https://a.example/", "<script>gtag('config', 'G'); gtag('event', 'x')</script>"),
    ("https://a.example/", "fbq('init', '1'); fbq('track', 'PageView'); connect.facebook.net"),
    ("https://a.example/", "canvas.getContext('2d'); canvas.toDataURL()"),
    ("https://shop.tiktok.com/", "ttq.track('AddToCart') CDN.SEGMENT.COM FullStory.com"),
    ("https://www.linkedin.com/", "clean"),
    ("https://www.linkedin.com/", ""),
]


@pytest.mark.parametrize("limit", [None, 500, 5])
def test_detection_in_row_and_by_table(spark, pages, limit, monkeypatch):
    want = {i: expected(u, h) if h else {} for i, (u, h) in enumerate(HTMLS)}
    if limit:
        monkeypatch.setattr(tables, "CHUNK_RULES", limit)
        found = catalog.detect_with_table(pages(*HTMLS), seeds.catalogue(spark))
    else:
        found = catalog.detect_in_pages(pages(*HTMLS))
    got = {i: {} for i in range(len(HTMLS))}
    for r in found.collect():
        got[r.page_id][r.tracker_id] = [tuple(m) for m in r.matches]
    assert got == want


def test_csv_round_trip(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "csv")
    cat = seeds.catalogue(spark)
    catalog_files.write_csv(cat, path)
    back = {r.tracker_id: r for r in catalog_files.read_csv(spark, path).collect()}
    assert len(back) == 22
    for r in cat.collect():
        b = back[r.tracker_id]
        assert (b.domains, b.data_types, b.first_seen) == (r.domains, r.data_types, r.first_seen)
        assert (b.pattern_count, b.gdpr_relevant) == (len(r.patterns), r.gdpr_relevant)
    assert back["webrtc_leak"].domains == []


def test_json_export(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "json")
    catalog_files.write_json(seeds.catalogue(spark), path)
    rows = spark.read.schema(seeds.CATALOGUE_SCHEMA).json(path)
    assert rows.agg(F.sum(F.size("patterns"))).first()[0] == 98


def test_large_catalogue_with_repeated_pages_and_null_lists(spark):
    extra = [
        (f"t{i}", f"n{i}", "analytics", "low", [f"mark_{i}\\(", f"host{i}\\w+x"], None if i % 2 else [f"h{i}.example"], "d", [], False, False, "script", [], "2024-01-01")
        for i in range(1700)
    ]
    extra[3] = (*extra[3][:4], None, *extra[3][5:])
    html = "mark_7( gtag('config', 'G') hostAx host12zzx h44.example"
    rows = [(1, "https://a.example/", html), (1, "https://a.example/", html), (None, "u", html), (None, "u", html), (2, "u", "clean")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    trackers = [*fixed.CATALOGUE, *extra]
    found = catalog.detect_with_table(df, seeds.catalogue(spark, trackers)).collect()
    want = catalog.detect_in_pages(df, trackers).collect()
    key = lambda r: (str(r.page_id), r.tracker_id, str(r.matches))
    assert sorted(map(key, found)) == sorted(map(key, want))
    ids = sorted(r.tracker_id for r in found if r.tracker_id.startswith("t") and r.tracker_id[1:].isdigit())
    assert ids == sorted(["t1", "t7", "t12", "t44"] * 4)


def pattern_rows(spark, *rows):
    return spark.createDataFrame(rows, "domain string, category string, patterns string, last_updated string")


def test_upserts_keep_a_domain_unique(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "patterns")
    with pytest.raises(FileNotFoundError):
        catalog_files.read_patterns(spark, path)
    first = pattern_rows(spark, ("a", "x", "[]", "1"), ("a", "y", "[]", "2"), ("b", "x", "[]", "5"), (None, "x", "[]", "9"))
    assert catalog_files.upsert_patterns(first, path) == 1
    assert catalog_files.upsert_patterns(first, path) == 2  # again: nothing changes
    late = pattern_rows(spark, ("b", "old", "[]", "4"), ("c", "z", '["p"]', "1"))
    assert catalog_files.upsert_patterns(late, path) == 3
    claim, races = catalog_files.folders.claim, []

    def other_writer_first(spark, file):
        if not races:
            races.append(1)
            catalog_files.upsert_patterns(pattern_rows(spark, ("d", "w", "[]", "1")), path)
        return claim(spark, file)

    monkeypatch.setattr(catalog_files.folders, "claim", other_writer_first)
    assert catalog_files.upsert_patterns(pattern_rows(spark, ("a", "new", "[]", "3")), path) == 5
    rows = sorted(tuple(r)[:2] for r in catalog_files.read_patterns(spark, path).collect())
    assert rows == [("a", "new"), ("b", "x"), ("c", "z"), ("d", "w")]
    assert len(list((tmp_path / "patterns/versions").iterdir())) == catalog_files.KEPT_VERSIONS
    (tmp_path / "patterns/claims/000000006").touch()  # a writer that died
    with pytest.raises(RuntimeError):
        catalog_files.upsert_patterns(late, path)
    assert catalog_files.upsert_patterns(late, path, recover=True) == 7
    assert catalog_files.read_patterns(spark, path).count() == 4
