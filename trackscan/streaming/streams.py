"""Streaming forms of the scan and of the time reports."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from trackscan.plans import rollups
from trackscan.plans.trends import is_change_alert, previous_by_key
from trackscan.sources.folders import names, remove
from trackscan.sources.history import HISTORY_SCHEMA, level_alerts
from trackscan.sources.pages import PAGE_SCHEMA

SHARED_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for stream state, below the one the cluster names.

    Without that setting only a local session gets a folder of its own: elsewhere executors
    could not see it.
    """
    root = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED_DIR} to a folder all executors share")
        root = tempfile.mkdtemp(prefix="trackscan-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def page_stream(
    spark: SparkSession, path: str, schema: str = PAGE_SCHEMA, files_per_batch: int | None = None
) -> DataFrame:
    """Page files as they arrive in a folder or glob. `scan` runs on it: a page needs no state."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def history_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(HISTORY_SCHEMA).parquet(path)


def daily_counts(history: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Scans, trackers and mean score per day; later rows than `lateness` are dropped."""
    return _per_window(history, lateness, F.window("scan_ts", "1 day"))


def weekly_counts(history: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The same per week. Windows count from a Thursday, so the offset starts them on Monday.

    Distinct urls are approximate: exact ones would have to be kept in state.
    """
    week = F.window("scan_ts", "7 days", "7 days", "4 days")
    return _per_window(
        history, lateness, week, F.approx_count_distinct("url").alias("distinct_urls")
    )


def _per_window(history: DataFrame, lateness: str, window, *extra) -> DataFrame:
    return (
        history.withWatermark("scan_ts", lateness)
        .groupBy(window.alias("w"))
        .agg(
            F.count("*").alias("scans"),
            F.sum("tracker_count").alias("trackers"),
            F.avg("privacy_score").alias("mean_score"),
            *extra,
        )
        .select(F.col("w.start").alias("window_start"), "scans", "trackers", "mean_score", *[
            c for c in ("distinct_urls",) if extra
        ])
    )


def drop_repeats(history: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Scans with the same outcome as an earlier one of the url are dropped."""
    return history.withWatermark("scan_ts", lateness).dropDuplicatesWithinWatermark(
        ["url", "result_hash"]
    )


def alert_stream(history: DataFrame, **limits: int) -> DataFrame:
    """Level alerts need no state."""
    return level_alerts(history, **limits)


# Parts of the state by a hash of the url; a batch reads and writes those that it has rows for.
STATE_BUCKETS = 64
_VALUES = ("privacy_score", "tracker_count")
_ROW = "url string, scan_ts timestamp, privacy_score int, tracker_count int, result_hash string"


def change_alert_writer(
    history: DataFrame,
    out: str,
    state: str,
    score_drop: float = 10,
    tracker_rise: float = 20,
    percent: bool = False,
    unit: str = "day",
    lateness_days: int = 30,
    buckets: int = STATE_BUCKETS,
) -> DataStreamWriter:
    """Writes alerts on the change since the last scan of a url, also across batches.

    Rows may come late by up to lateness_days behind the newest row of earlier batches. A late row
    is compared with the row before it in time, and the row after it is compared anew: a verdict
    on that row, an alert or none, is written again and `change_alerts_of` takes the newest. So the
    result is that of the batch form. Rows that are later still are kept apart below late/.

    The state is cut into buckets by url. It holds the rows of the last lateness_days and the row
    before them of each url. A batch reads the buckets that its urls fall into, and writes them
    anew into a folder of its own; a small table says for each bucket which batch wrote it last.
    A batch that runs again after a failure finds what it found before, and overwrites its own
    folders. State and alerts lie below run=<id>, the id of the checkpoint: a stream that is
    started anew from its checkpoint goes on in its own run, and one with a new checkpoint starts a
    run beside it and touches nothing of the other's.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        run = f"run={spark.sparkContext.getLocalProperty('sql.streaming.queryId') or '0'}"
        home = f"{state}/{run}"
        newest, written = _state_of(spark, home, epoch)
        bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
        # The rows are read several times; without this the scan behind them would run as often.
        rows = batch.select("url", "scan_ts", *_VALUES, "result_hash").withColumn("bucket", bucket).persist()
        try:
            bound = None if newest is None else newest - dt.timedelta(days=lateness_days)
            if bound is not None:
                late = F.coalesce(F.col("scan_ts") <= F.lit(bound), F.lit(False))
                rows.filter(late).write.mode("overwrite").parquet(f"{home}/late/batch={epoch}")
                fresh = rows.filter(~late)
            else:
                fresh = rows
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # buckets at most
            held = [f"{home}/rows/batch={written[b]}/bucket={b}" for b in touched if b in written]
            if held:
                before = spark.read.schema(_ROW).parquet(*held)
            else:
                before = spark.createDataFrame([], _ROW)
            both = (
                before.withColumn("bucket", bucket)
                .withColumn("_new", F.lit(False))
                .unionByName(fresh.withColumn("_new", F.lit(True)))
            )
            fell, rose = is_change_alert(score_drop, tracker_rise, percent)
            judged = previous_by_key(both, "url", "scan_ts", [*_VALUES, "_new"], ["result_hash"], unit)
            # what is new, and what now stands behind something new
            (
                judged.withColumn("score_fell", fell)
                .withColumn("trackers_rose", rose)
                .withColumn("again", ~F.col("_new"))
                .filter(F.when(F.col("again"), F.col("previous._new")).otherwise(F.expr("score_fell OR trackers_rose")))
                .withColumn("previous", F.col("previous").dropFields("_new"))
                .drop("_new", "bucket")
                .write.mode("overwrite")
                .parquet(f"{out}/{run}/batch={epoch}")
            )
            top = rows.agg(F.max("scan_ts")).first()[0]
            newest = max((t for t in (newest, top) if t is not None), default=None)
            _write_state(both, f"{home}/rows/batch={epoch}", newest, lateness_days)
            after = {**written, **dict.fromkeys(touched, epoch)}
            table = [(newest, [(b, e) for b, e in sorted(after.items())])]
            spark.createDataFrame(table, _STATE).coalesce(1).write.mode("overwrite").parquet(
                f"{home}/state/batch={epoch}"
            )
            _remove_old(spark, home, epoch, {*written.values(), *after.values()})
        finally:
            rows.unpersist()

    return history.writeStream.foreachBatch(handle)


_STATE = "newest timestamp, written array<struct<bucket:int,batch:long>>"


def _batches(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in names(spark, folder) if n.startswith("batch="))


def _state_of(spark: SparkSession, home: str, epoch: int):
    """(newest row's time, batch that wrote a bucket last) as the batches before this one left them."""
    done = [n for n in _batches(spark, f"{home}/state") if n < epoch and "_SUCCESS" in names(spark, f"{home}/state/batch={n}")]
    if not done:
        return None, {}
    row = spark.read.schema(_STATE).parquet(f"{home}/state/batch={done[-1]}").first()
    return row["newest"], {x["bucket"]: x["batch"] for x in row["written"]}


def _write_state(both: DataFrame, path: str, newest, lateness_days: int) -> None:
    """Rows of the last lateness_days, and of each url the last one before them."""
    rows = both.drop("_new").filter("url IS NOT NULL AND scan_ts IS NOT NULL")
    if newest is None:
        kept = rows
    else:
        old = F.col("scan_ts") <= F.lit(newest - dt.timedelta(days=lateness_days))
        columns = ["scan_ts", *_VALUES, "result_hash", "bucket"]
        last = F.max_by(F.struct(*columns), F.struct("scan_ts", "result_hash"))
        before = rows.filter(old).groupBy("url").agg(last.alias("row")).select("url", "row.*")
        kept = rows.filter(~old).unionByName(before)
    share = F.pmod(F.xxhash64("url", "scan_ts"), F.lit(4))  # a hot url has several writers
    kept.repartition("bucket", share).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _remove_old(spark: SparkSession, home: str, epoch: int, used: set[int]) -> None:
    """Folders that neither this batch nor, should it run again, the one before it reads."""
    for n in _batches(spark, f"{home}/rows"):
        if n < epoch and n not in used:
            remove(spark, f"{home}/rows/batch={n}")
    for n in _batches(spark, f"{home}/state")[:-2]:
        remove(spark, f"{home}/state/batch={n}")


def change_alerts_of(spark: SparkSession, out: str) -> DataFrame:
    """The alerts that a change_alert_writer has written, each row with its newest verdict."""
    keys = ["run", "url", "scan_ts", "result_hash", *_VALUES]
    written = spark.read.parquet(out)
    rest = [c for c in written.columns if c not in (*keys, "again")]
    first = written.filter("NOT again")
    anew = written.filter("again").groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "batch").alias("_anew"), F.max("batch").alias("_batch")
    )
    # a row that is judged again had an alert or not; either is replaced
    kept = first.join(anew.select(*keys), keys, "left_anti").select(*keys, *rest)
    return kept.unionByName(anew.select(*keys, "_anew.*").select(*keys, *rest)).filter(
        "score_fell OR trackers_rose"
    )


def history_writer(history: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends a stream of history rows to the table, by date."""
    return (
        history.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("scan_date")
        .outputMode("append")
    )


def rollup_writer(scanned: DataFrame, path: str) -> DataStreamWriter:
    """Keeps the daily rollup of a stream of scan results: one small partial table per batch.

    A batch that runs again replaces its own. path belongs to the checkpoint, whose batches it
    numbers; `rollups.stored` reads it, and `rollups.compact` may run up to the batch before last.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        rollups.write_batch(rollups.daily_parts(batch), path, epoch)

    return scanned.writeStream.foreachBatch(handle)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what is there and return it as a table in the shared folder.

    Append streams go through the exactly-once file sink. Other modes replace the table with
    the result of the last batch.
    """
    spark = stream.sparkSession
    path = f"{folder}/table"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(path)
        )
    query = (
        writer.option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
