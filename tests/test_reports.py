"""Reports, history, trends, security and anomalies against plain Python."""

import datetime as dt
import os
import random
import re
import statistics
import tempfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trackscan import scan
from trackscan.operators import anomaly, cluster, enrich, security
from trackscan.plans import reports, trends
from trackscan.sources import catalog_files, history, pages as page_source, results

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def hot_history(spark):
    """4,000 scans of which one url has well over a third, within few days."""
    rng = random.Random(7)
    rows = []
    for i in range(4000):
        url = "hot" if rng.random() < 0.5 else f"u{rng.randrange(60)}"
        ts = START + dt.timedelta(seconds=rng.randrange(6 * 86400), microseconds=i)
        rows.append((url, ts, rng.randrange(120), rng.randrange(101), f"h{i}"))
    schema = "url string, scan_ts timestamp, tracker_count int, privacy_score int, result_hash string"
    return rows, spark.createDataFrame(rows, schema).repartition(8).cache()


def by_url(rows):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: r[1]):
        groups[row[0]].append(row)
    return groups


@pytest.mark.parametrize("unit", ["hour", "day", "week"])
def test_previous_row_across_spans(hot_history, unit):
    rows, df = hot_history
    want = {}
    for group in by_url(rows).values():
        for before, row in zip([None, *group], group):
            want[row[4]] = before and (before[1], before[3])
    got = trends.previous(df, "url", "scan_ts", ["privacy_score"], unit=unit).collect()
    assert len(got) == len(rows)
    assert {r.result_hash: r.previous and tuple(r.previous) for r in got} == want


def test_change_alerts(hot_history):
    rows, df = hot_history
    want = set()
    for group in by_url(rows).values():
        for before, row in zip(group, group[1:]):
            if before[3] - row[3] >= 10 or row[2] - before[2] >= 20:
                want.add(row[4])
    assert {r.result_hash for r in trends.change_alerts(df).collect()} == want


def test_zscores_with_hot_and_flat_metrics(spark):
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(3000)] + [("flat", 5.0)] * 50
    rows += [("few", float(v)) for v in (1, 1, 1, 1, 1, 1, 9)] + [(None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "m string, v double")
    got = Counter((r.m, r.v) for r in anomaly.zscores(df, "m", "v").filter("is_anomaly").collect())
    want = Counter()
    for m in {m for m, _ in rows}:
        vs = [v for k, v in rows if k == m]
        mean, spread = statistics.fmean(vs), statistics.pstdev(vs)
        want.update((m, v) for v in vs if spread and (v - mean) / spread > 2)
    assert got == want and want["few", 9.0] == 1


def test_anomaly_of_one_scan(spark):
    values = [[1.0] * 9 + [50.0], [1.0, 2.0, 3.0], [5.0, 5.0], []]
    df = spark.createDataFrame([(v,) for v in values], "v array<double>")
    got = [r[0] for r in df.select(anomaly.scan_anomaly(F.col("v"))).collect()]
    assert got == [True, False, False, False]


def test_anomaly_of_one_scan_on_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    values = [None, [None], [1.0, None, 2.0], [nan, 1.0], [inf, 1.0], [0.0], [1.0] * 6 + [9.0]]
    df = spark.createDataFrame([(v,) for v in values], "v array<double>")
    got = [r[0] for r in df.select(anomaly.scan_anomaly(F.col("v"))).collect()]
    assert got == [None, None, None, False, False, False, True]


def test_anomaly_of_one_scan_reads_its_metrics_once(spark):
    k = F.get_json_object("props", "$.k").cast("double")
    df = spark.createDataFrame([('{"k": 9}',)], "props string")
    scored = df.select(anomaly.scan_anomaly(F.array(k, *[F.lit(1.0)] * 6)).alias("a"))
    assert scored.first().a is True
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1


def test_history_append_and_filters(spark, hot_history):
    rows, df = hot_history
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "history")
    dated = df.withColumn("scan_date", F.to_date("scan_ts"))
    for part in dated.randomSplit([0.5, 0.5], 1):
        history.append(part, path, files_per_day=3)
    table = history.read(spark, path)
    assert table.count() == len(rows)
    as_of = F.lit("2024-01-05 12:00:00").cast("timestamp")
    recent = history.last_days(table, as_of, 2)
    since = dt.datetime(2024, 1, 3, 12)
    assert recent.count() == sum(r[1] >= since for r in rows)
    # The date bound prunes folders of the table.
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scan_date" in plan
    kept = history.retained(table, as_of, 2)
    assert kept.count() == sum(r[1].date() >= dt.date(2024, 1, 3) for r in rows)
    alerts = {r.result_hash: r.reasons for r in history.level_alerts(table).collect()}
    assert set(alerts) == {r[4] for r in rows if r[3] < 60 or r[2] > 50}


def test_equal_outcomes_hash_alike(pages):
    html = '<img src="https://criteo.com/a"><script src="https://sentry.io/"></script>'
    rows = history.history_rows(scan(pages(html, html + "<p>", "<p>", ""))).collect()
    assert len(rows) == 3
    assert len({r.result_hash for r in rows}) == 2


def test_batch_totals(pages, spark):
    scanned = scan(pages('<img src="https://criteo.com/a">' * 3, "<p>", "", ""))
    row = reports.batch_totals(scanned).first()
    assert tuple(row) == (4, 3, 1, 0.75)
    empty = scan(spark.createDataFrame([], "page_id bigint, url string, html string"))
    assert tuple(reports.batch_totals(empty).first()) == (0, 0, 0, 0.0)


def test_metrics_buckets(spark):
    scans = spark.createDataFrame(
        [(2, 10, 0.5), (3, 11, 99.0)], "tracker_count int, privacy_score int, scan_duration double"
    )
    got = {(r.metric, r.le): r.value for r in reports.metrics(scans, (10, 20), (1,)).collect()}
    assert got == {
        ("scans_total", None): 2,
        ("trackers_detected_total", None): 5,
        ("privacy_score_histogram", 10.0): 1,
        ("privacy_score_histogram", 20.0): 1,
        ("scan_duration_seconds", 1.0): 1,
        ("scan_duration_seconds", float("inf")): 1,
    }


def test_results_round_trip(spark, pages):
    folder = tempfile.mkdtemp(prefix="run-")
    scanned = scan(pages('<img src="/track"><script>track(1)</script>', ""))
    results.write_json(scanned, f"{folder}/json")
    back = results.read_json(spark, f"{folder}/json").orderBy("page_id").collect()
    assert back[0].tracking_pixels[0].src == "/track"
    assert back[1].error and back[1].summary is None
    results.export_csv(scanned, f"{folder}/csv")
    assert spark.read.option("header", True).csv(f"{folder}/csv").count() == 2
    # A recorded file: one array, fields missing.
    with open(f"{folder}/one.json", "w") as f:
        f.write('[{"url": "u", "pixel_count": 1,\n "tracking_pixels": [{"src": "s"}]}]')
    one = results.read_json(spark, f"{folder}/one.json", one_document=True).first()
    assert (one.url, one.pixel_count, one.privacy_analysis) == ("u", 1, None)


def test_latest_pattern_row(spark):
    rows = [
        ("a", "x", '["p"]', START),
        ("a", "y", '["q","r"]', START + dt.timedelta(1)),
        ("b", "z", "[]", START),
    ]
    df = spark.createDataFrame(
        rows, "domain string, category string, patterns string, last_updated timestamp"
    )
    got = {r.domain: (r.category, r.patterns) for r in catalog_files.latest_patterns(df).collect()}
    assert got == {"a": ("y", ["q", "r"]), "b": ("z", [])}


def test_security_golden(spark):
    df = spark.createDataFrame(
        [(1, "https://example.com", {}), (2, "http://x", {"content-security-policy": "a 'self'; b"})],
        "page_id bigint, url string, headers map<string,string>",
    )
    first, second = security.audit(df).orderBy("page_id").collect()
    assert first.https_enabled and not second.https_enabled
    assert [h.security_level for h in first.security_headers] == [
        "vulnerable",
        "vulnerable",
        "vulnerable",
        "warning",
        "vulnerable",
        "warning",
    ]
    assert first.csp_analysis.security_score == 0
    assert first.recommendations[0].startswith("Implement Content Security Policy")
    assert first.recommendations[2] == "Add Strict-Transport-Security header: HSTS header enforces HTTPS"
    assert len(first.recommendations) == 8
    assert second.csp_analysis.directives == ["a 'self'", "b"]
    certs = spark.createDataFrame([("2026-01-15 23:59:59",)], "t string").select(
        F.to_timestamp("t").alias("valid_to")
    )
    row = security.certificates(certs, F.lit("2025-06-25 15:36:30").cast("timestamp")).first()
    assert (row.days_until_expiry, row.is_expired) == (204, False)
    one = spark.createDataFrame(
        [(50, "vulnerable", True)],
        "overall_security_score int, security_level string, https_enabled boolean",
    )
    assert tuple(security.summary(one).first()) == (1, 50.0, 0, 1)


def test_mixed_content(pages):
    html = '<img src="HTTP://a/1"><img src="https://a/2"><a href="http://a/3">'
    rows = security.mixed_content(pages(html, ("http://plain.example/", html))).collect()
    assert [(r.page_id, r.src) for r in rows] == [(0, "HTTP://a/1")]


def test_domain_analysis(spark):
    addresses = spark.createDataFrame([("https://a/1",), ("https://a/2",), ("https://b/",)], "url string")
    info = spark.createDataFrame([("a", "reg")], "domain string, registrar string")
    rows = {r.domain: (r.registrar, r.error) for r in enrich.domain_analysis(addresses, info).collect()}
    assert rows == {"a": ("reg", None), "b": (None, "no record")}


def test_clusters(spark):
    names = [f"ads{i}.alpha.com" for i in range(10)] + [f"zzz{i}.omega.net" for i in range(10)]
    df = spark.createDataFrame([(n,) for n in names * 2], "domain string")
    first = {r.domain: r.cluster for r in cluster.cluster_domains(df, k=2).collect()}
    again = {r.domain: r.cluster for r in cluster.cluster_domains(df, k=2).collect()}
    assert first == again and set(first) == set(names)
    assert first["ads1.alpha.com"] != first["zzz1.omega.net"]
    few = cluster.cluster_domains(df.limit(3), k=5).collect()
    assert {r.cluster for r in few} == {0}


def test_clusters_from_a_sample_cover_all_hosts(spark):
    names = [f"ads{i}.alpha.com" for i in range(60)] + [f"zzz{i}.omega.net" for i in range(60)]
    df = spark.createDataFrame([(n,) for n in [*names, "", None]], "domain string")
    found = cluster.fit(df, k=2, sample=30)
    apart = cluster.distances(F.col("features"), found.centres)
    rows = found.hosts.withColumn("apart", apart).collect()
    assert sorted(r.domain for r in rows) == sorted(names) and len(found.centres) == 2
    for r in rows:
        plain = [sum((x - c) ** 2 for x, c in zip(r.features.toArray(), centre)) for centre in found.centres]
        assert plain == pytest.approx(r.apart) and r.cluster == plain.index(min(plain))
    assert len({r.cluster for r in rows if "alpha" in r.domain}) == 1 == len({r.cluster for r in rows if "omega" in r.domain})
    assert cluster.fit(df.limit(0)).hosts.count() == 0


def test_only_small_input_is_spread(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert page_source.spread(df).rdd.getNumPartitions() == 8
    monkeypatch.setattr(page_source, "SPREAD_BELOW_BYTES", 0)
    assert page_source.spread(df) is df


@pytest.mark.parametrize("rows", [50_000, 7])
def test_previous_keeps_all_rows_and_splits_a_hot_day(spark, rows, monkeypatch):
    monkeypatch.setattr(trends, "SPAN_ROWS", rows)
    hot = [("hot", f"2024-01-02 {h:02}:{m:02}:00", 100 * h + m) for h in range(5) for m in range(60)]
    data = hot + [("cold", "2024-01-01 00:00:00", 1), ("cold", "2024-03-01 00:00:00", 2)]
    data += [(None, "2024-01-02 00:00:00", 3), (None, "2024-01-02 01:00:00", 4), ("hot", None, 5), (None, None, 6)]
    df = spark.createDataFrame(data, "url string, at string, v int").withColumn("at", F.to_timestamp("at"))
    got = {r.v if r.url != "hot" or r.at is None else ("hot", r.v): r.previous and r.previous.v for r in trends.previous(df, "url", "at", ["v"]).collect()}
    values = sorted(v for _, _, v in hot)
    want = {("hot", v): before for before, v in zip([None, *values], values)}
    assert got == {**want, 1: None, 2: 1, 3: None, 4: None, 5: None, 6: None}


def shuffles(df):
    """Shuffles that ran, without those whose result was used again."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line for line in plan.splitlines() if " Exchange " in f" {line} " and "Reused" not in line], plan


def test_previous_shuffles_the_rows_once(spark, hot_history):
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "rows")
    hot_history[1].write.parquet(path)
    ran, plan = shuffles(trends.previous(spark.read.parquet(path), "url", "scan_ts", ["privacy_score"]))
    assert "ReusedExchange" in plan and sum("_part#" in line for line in ran) == 1


def test_only_split_keys_meet_again_by_key(spark, monkeypatch):
    """Keys of few rows a span have all their rows outermost; they were shuffled twice before."""
    monkeypatch.setattr(trends, "SPAN_ROWS", 20)
    data = [(f"u{i % 50}", i // 50, i) for i in range(500)] + [("hot", i // 5, i) for i in range(100)]
    df = spark.createDataFrame(data, "url string, day int, v int").select(
        "url", "v", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day, 0, 0, v / 1000)").alias("at")
    )
    none = [(None, 1000, None), ("hot", 1001, None), ("u1", 1002, None)]
    ats = df.unionByName(spark.createDataFrame(none, "url string, v int, at timestamp"))
    found = trends.previous_by_key(ats, "url", "at", ["v"])
    rows = found.select("url", "v", F.col("previous.v").alias("p")).collect()
    last = {}
    for url, _, v in sorted(data, key=lambda x: x[2]):
        last[url, v] = max((w for u, w in last if u == url), default=None)
    last.update({(u, v): None for u, v, _ in none})
    assert {(r.url, r.v): r.p for r in rows} == last and len(rows) == len(data) + 3
    _, split = trends._split_keys(df, "url", "at", "day")
    assert {r.url for r in split.collect()} == {"hot"}
    monkeypatch.setattr(trends, "SPAN_ROWS", 50_000)
    history = df.selectExpr("url", "at AS scan_ts", "v AS privacy_score", "v AS tracker_count", "'h' AS result_hash")
    ran, plan = shuffles(trends.change_alerts(history))
    assert sum("_part#" in line for line in ran) == len(ran) == 1 and plan.count("Window [") == 1


def test_bucketed_history_is_not_shuffled(spark, hot_history):
    rows, df = hot_history
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "history")
    for part in df.randomSplit([0.6, 0.4], 1):
        history.append_bucketed(part, "bucketed_history_test", path, buckets=4)
    table = spark.table("bucketed_history_test")
    got = trends.previous(table, "url", "scan_ts", ["privacy_score"], part=history.PART)
    want = trends.previous(df, "url", "scan_ts", ["privacy_score"]).collect()
    assert {r.result_hash: r.previous for r in got.collect()} == {r.result_hash: r.previous for r in want}
    assert got.count() == len(rows)
    ran, plan = shuffles(got)
    # only the outermost rows of each part are dealt out, by url
    assert len(ran) == 1 and re.search(r"hashpartitioning\(url#\d+, \d+\)", ran[0])
    # the hot url is in several buckets
    assert table.filter("url = 'hot'").select(F.input_file_name()).distinct().count() > 4
    spark.sql("DROP TABLE bucketed_history_test")


def test_equal_rows_keep_their_number(spark):
    data = [("u", "2024-01-01 00:00:00", 1)] * 50 + [("u", "2024-01-02 00:00:00", 2)] * 50
    df = spark.createDataFrame(data, "url string, at string, v int").withColumn("at", F.to_timestamp("at"))
    got = Counter((r.v, r.previous and r.previous.v) for r in trends.previous(df.repartition(7), "url", "at", ["v"]).collect())
    assert got == {(1, None): 1, (1, 1): 49, (2, 1): 1, (2, 2): 49}


def stored_history(spark, df, path):
    dated = df.withColumn("scan_date", F.to_date("scan_ts"))
    history.append(dated, path, files_per_day=2)


def test_expired_dates_go_and_a_failure_loses_nothing(spark, hot_history, monkeypatch):
    rows, df = hot_history
    as_of = dt.datetime(2024, 1, 5, 12)
    since = dt.datetime(2024, 1, 3, 12)
    want = sorted(r[1] for r in rows if r[1] >= since)

    def left(path):
        return sorted(r[0] for r in history.read(spark, path).select("scan_ts").collect())

    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "history")
    stored_history(spark, df, path)
    days = sorted({r[1].date() for r in rows})
    gone = history.expire(spark, path, as_of, 2)
    assert gone == [str(d) for d in days if d < since.date()] and left(path) == want
    assert not any(n in os.listdir(path) for n in (f"scan_date={g}" for g in gone))
    assert history.expire(spark, path, as_of, 2) == [] and left(path) == want
    # stopped after the folder of the date in part was lost
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "history")
    stored_history(spark, df, path)
    whole, write = left(path), history._write_date

    def stops(spark, copy, table):
        history.folders.remove(spark, f"{table}/scan_date={since.date()}")
        raise OSError("stopped")

    monkeypatch.setattr(history, "_write_date", stops)
    with pytest.raises(OSError):
        history.expire(spark, path, as_of, 2)
    monkeypatch.setattr(history, "_write_date", write)
    history.expire(spark, path, as_of, 2)
    assert left(path) == want
    # stopped before: the copy is old, and rows that came since are not lost
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "history")
    stored_history(spark, df, path)
    monkeypatch.setattr(history, "_write_date", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        history.expire(spark, path, as_of, 2)
    monkeypatch.setattr(history, "_write_date", write)
    assert left(path) == whole
    stored_history(spark, df.limit(5).withColumn("scan_ts", F.lit(dt.datetime(2024, 1, 3, 20))), path)
    history.expire(spark, path, as_of, 2)
    assert left(path) == sorted([*want, *[dt.datetime(2024, 1, 3, 20)] * 5])


def test_seek_pages_follow_one_another(spark):
    times = [dt.datetime(2024, 1, 1 + i // 3) for i in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "page_id long, scan_timestamp timestamp")
    shown, after = [], None
    while page := reports.seek(df, 4, after).collect():
        shown += [r.page_id for r in page]
        after = (page[-1].scan_timestamp, page[-1].page_id)
    assert shown == [r.page_id for r in reports.paged(df, 20).collect()]
