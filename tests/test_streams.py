"""Streams give what the batch forms give, also over several batches and after a restart."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from trackscan import scan
from trackscan.plans import trends
from trackscan.sources import history
from trackscan.sources.planted import SCAN_TS, web_pages
from trackscan.streaming import streams

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def files(spark):
    """History files that arrive in order, a few days each."""
    rng = random.Random(5)
    folder = tempfile.mkdtemp(prefix="run-")
    rows = []
    for i in range(900):
        url = "hot" if i % 2 else f"u{rng.randrange(12)}"
        ts = START + dt.timedelta(minutes=20 * i)
        rows.append((url, ts, rng.randrange(90), rng.randrange(101), f"h{rng.randrange(4)}", ts.date()))
    for n in range(3):
        part = spark.createDataFrame(rows[n * 300 : (n + 1) * 300], history.HISTORY_SCHEMA)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return rows, folder


def stream(spark, folder):
    return (
        spark.readStream.schema(history.HISTORY_SCHEMA)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{folder}/in")
    )


def test_scan_on_a_stream_equals_batch(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    columns = ["page_id", "error", "pixel_count", "summary", "privacy_analysis", "scan_timestamp"]

    def run(pages):
        return scan(web_pages(pages), scan_ts=F.expr(SCAN_TS)).select(*columns)

    live = streams.run_to_table(
        run(streams.page_stream(spark, path + "*")), streams.shared_folder(spark, "t")
    )
    batch = run(spark.read.parquet(path))
    assert sorted(map(str, live.collect())) == sorted(map(str, batch.collect()))


def test_change_alerts_across_batches(spark, files):
    rows, folder = files
    query = (
        streams.change_alert_writer(stream(spark, folder), f"{folder}/out", f"{folder}/state")
        .option("checkpointLocation", f"{folder}/cp")
        .trigger(availableNow=True)
    )
    query.start().awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    want = trends.change_alerts(spark.read.schema(history.HISTORY_SCHEMA).parquet(f"{folder}/in"))
    keys = ["url", "scan_ts", "score_fell", "trackers_rose"]
    assert sorted(map(str, got.select(keys).collect())) == sorted(map(str, want.select(keys).collect()))
    assert {r.batch for r in got.select("batch").distinct().collect()} == {0, 1, 2}
    # a new checkpoint is a run of its own, and leaves the first one as it is
    again = streams.change_alert_writer(stream(spark, folder), f"{folder}/out", f"{folder}/state")
    again.option("checkpointLocation", f"{folder}/cp2").trigger(availableNow=True).start().awaitTermination()
    runs = spark.read.parquet(f"{folder}/out").groupBy("run").count().collect()
    assert [r["count"] for r in runs] == [want.count()] * 2


def test_daily_and_weekly_windows(spark, files):
    rows, folder = files
    daily = streams.run_to_table(streams.daily_counts(stream(spark, folder)), f"{folder}/d")
    last = max(r[1] for r in rows) - dt.timedelta(days=1)
    days = {}
    for r in rows:
        days.setdefault(r[5], []).append(r)
    want = {
        dt.datetime.combine(d, dt.time()): (len(v), sum(r[2] for r in v))
        for d, v in days.items()
        if dt.datetime.combine(d, dt.time()) + dt.timedelta(days=1) <= last
    }
    assert {r.window_start: (r.scans, r.trackers) for r in daily.collect()} == want
    weekly = streams.run_to_table(streams.weekly_counts(stream(spark, folder)), f"{folder}/w")
    assert [r.window_start.weekday() for r in weekly.collect()] == [0]
    assert weekly.first().distinct_urls == 13


def test_repeats_are_dropped(spark, files):
    rows, folder = files
    table = streams.run_to_table(streams.drop_repeats(stream(spark, folder)), f"{folder}/r")
    assert table.count() == len({(r[0], r[4]) for r in rows})


def test_history_stream_and_restart(spark, files):
    rows, folder = files

    def run():
        streams.history_writer(stream(spark, folder), f"{folder}/t", f"{folder}/hcp").trigger(
            availableNow=True
        ).start().awaitTermination()

    run()
    run()
    assert history.read(spark, f"{folder}/t").count() == len(rows)


class Session:
    """As much of a session as the folder depends on."""

    def __init__(self, master, **settings):
        self.conf = self
        self.sparkContext = self
        self.master = master
        self.settings = settings

    def getConf(self):
        return self

    def get(self, name, default=None):
        return self.settings.get(name, default)


def test_shared_folder_needs_the_setting_on_a_cluster():
    set_ = Session("yarn", **{"spark.checkpoint.dir": "hdfs:/shared/"})
    assert streams.shared_folder(set_, "a").startswith("hdfs:/shared/a-")
    assert "trackscan-" in streams.shared_folder(Session("local[2]"), "a")
    with pytest.raises(ValueError):
        streams.shared_folder(Session("yarn"), "a")


def test_change_alert_query_keeps_partitions(spark, tmp_path, monkeypatch):
    """Each third of the events is one batch, written by as many tasks as read it."""
    from checks import query_set

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300).repartition(4)
    events.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(query_set.streams, "shared_folder", lambda *_: f"{tmp_path}/run")
    monkeypatch.setattr(query_set, "load", lambda s, sf, name: s.read.parquet(f"{sf}/{name}.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    try:
        query_set.stream_change_alerts(spark, str(tmp_path)).count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list((tmp_path / "run/events").glob("part-*"))) > 3
    assert len(list((tmp_path / "run/checkpoint/commits").glob("[0-9]*"))) == 3


def written(spark, folder, parts):
    """History files that arrive in the order of parts."""
    for part in parts:
        spark.createDataFrame(part, history.HISTORY_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_late_rows_give_the_batch_alerts(spark, files):
    rows, folder = files
    mixed = random.Random(3).sample(rows, len(rows))
    mixed += [(None, START, 1, 1, "x", START.date()), ("u1", None, 1, 1, "x", None)]
    late = tempfile.mkdtemp(prefix="run-")
    written(spark, late, [mixed[i::4] for i in range(4)])
    writer = streams.change_alert_writer(stream(spark, late), f"{late}/out", f"{late}/state", lateness_days=60)
    writer.option("checkpointLocation", f"{late}/cp").trigger(availableNow=True).start().awaitTermination()
    got = streams.change_alerts_of(spark, f"{late}/out")
    want = trends.change_alerts(spark.createDataFrame(mixed, history.HISTORY_SCHEMA))
    keys = ["url", "scan_ts", "score_fell", "trackers_rose", "previous.privacy_score", "previous.scan_ts"]
    assert sorted(map(str, got.select(keys).collect())) == sorted(map(str, want.select(keys).collect()))
    assert got.count() > 100


def test_state_of_changes_by_bucket(spark, files):
    """A batch writes the buckets of its urls only; rows that are too late are kept apart."""
    _, folder = files
    day = dt.timedelta(days=1)

    def row(url, n, score):
        ts = START + n * day
        return (url, ts, 5, score, f"h{n}", ts.date())

    urls = [f"u{i}" for i in range(30)]
    parts = [[row(u, 0, 90) for u in urls], [row("u3", 1, 50)], [row("u3", 9, 20), row("u3", 4, 60)], [row("u3", 2, 1), row("u3", 10, 5)]]
    late = tempfile.mkdtemp(prefix="run-")
    for part in parts:
        written(spark, late, [part])
        writer = streams.change_alert_writer(stream(spark, late), f"{late}/out", f"{late}/state", lateness_days=6, buckets=8)
        writer.option("checkpointLocation", f"{late}/cp").trigger(availableNow=True).start().awaitTermination()
    got = [(r.scan_ts, r.previous.privacy_score, r.privacy_score) for r in streams.change_alerts_of(spark, f"{late}/out").collect()]
    assert sorted(got) == [(START + day, 90, 50), (START + 9 * day, 60, 20), (START + 10 * day, 20, 5)]
    from pathlib import Path

    (home,) = Path(late, "state").iterdir()
    by_batch = {p.name: len(list(p.glob("bucket=*"))) for p in (home / "rows").iterdir()}
    assert by_batch["batch=0"] > 3 and by_batch["batch=3"] == 1 and "batch=1" not in by_batch
    assert spark.read.parquet(str(home / "late")).count() == 1
