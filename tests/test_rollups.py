"""Rollups by batches against reports over all scans at once."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from trackscan import scan
from trackscan.plans import reports, rollups, trends
from trackscan.sources import folders

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def scans(spark):
    hosts = ["criteo.com", "doubleclick.net", "facebook.com", "sentry.io"]
    rows = [
        (i, f"https://s{i % 40}.example/", "".join(f'<img src="https://{h}/{i}">' for h in hosts[: i % 5]))
        for i in range(120)
    ]
    rows += [(200, "https://gone.example/", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    at = F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("page_id") * 7200)
    return scan(pages, scan_ts=at, with_source=False).cache()


def rows_of(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def third(scans, b):
    return rollups.daily_parts(scans.filter(F.col("page_id") % 3 == b))


def test_batches_count_once(spark, scans):
    path = f"{tempfile.mkdtemp(prefix='run-')}/rollup"
    want = rows_of(reports.api_statistics(scans))

    def now():
        return rows_of(rollups.statistics(rollups.stored(spark, path)))

    for b in (0, 1, 2, 1, 1):
        assert rollups.write_batch(third(scans, b), path, b)
    assert now() == want
    rollups.compact(spark, path, 1)
    assert now() == want and folders.names(spark, path) == ["base=1", "batch=2"]
    assert not rollups.write_batch(third(scans, 0), path, 0)
    rollups.compact(spark, path, 2)
    rollups.compact(spark, path, 2)
    assert now() == want and folders.names(spark, path) == ["base=2"]


def test_stopped_runs_are_not_read(spark, scans, monkeypatch):
    path = f"{tempfile.mkdtemp(prefix='run-')}/rollup"
    for b in range(3):
        rollups.write_batch(third(scans, b), path, b)
    want = rows_of(rollups.statistics(rollups.stored(spark, path)))
    # a base without its mark of completion, and a batch that was broken off
    third(scans, 0).write.parquet(f"{path}/base=7")
    folders.remove(spark, f"{path}/base=7/_SUCCESS")
    third(scans, 0).write.parquet(f"{path}/batch=3")
    folders.remove(spark, f"{path}/batch=3/_SUCCESS")
    assert rows_of(rollups.statistics(rollups.stored(spark, path))) == want
    with pytest.raises(ValueError):
        rollups.compact(spark, path, 3)
    # stopped between the base and the removal of its batches
    monkeypatch.setattr(folders, "remove", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        rollups.compact(spark, path, 1)
    assert rows_of(rollups.statistics(rollups.stored(spark, path))) == want
    monkeypatch.undo()
    rollups.compact(spark, path, 2)
    assert rows_of(rollups.statistics(rollups.stored(spark, path))) == want
    assert folders.names(spark, path) == ["base=2", "batch=3"]
    with pytest.raises(FileNotFoundError):
        rollups.stored(spark, path + "-none")


def test_weeks_from_days(spark, scans):
    parts = rollups.merge_daily(third(scans, 0).union(third(scans, 1)).union(third(scans, 2)))
    got = {r.week: r for r in rollups.per_period(parts).collect()}
    for r in trends.weekly(scans).collect():
        own = got[r.week]
        assert (own.pages, own.trackers, own.low, own.medium, own.high) == (r.pages, r.trackers, r.low, r.medium, r.high)
        assert own.domains == r.domains and abs(own.mean_score - r.mean_score) < 1e-9
    urls = scans.filter("error IS NULL").groupBy(F.to_date(F.date_trunc("week", "scan_timestamp")).alias("week"))
    assert all(got[r.week].urls == r.n for r in urls.agg(F.count_distinct("url").alias("n")).collect())


def test_estimates_of_many_urls(spark):
    ids = spark.range(200_000).select(F.concat(F.lit("https://s"), "id").alias("url"), (F.col("id") % 5).alias("d"))
    sketches = ids.groupBy("d").agg(F.hll_sketch_agg("url", rollups.LG_K).alias("urls"))
    estimate = sketches.agg(rollups._distinct("urls")).first()[0]
    assert abs(estimate - 200_000) <= 0.03 * 200_000


def test_no_scans(spark, scans):
    parts = rollups.daily_parts(scans.limit(0))
    assert parts.count() == 0 and rollups.per_period(parts).count() == 0
    assert rows_of(rollups.statistics(parts)) == rows_of(reports.api_statistics(scans.limit(0)))
