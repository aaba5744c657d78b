"""Changes over time: daily and weekly tables, trends, baselines, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from trackscan.plans.reports import tally_by


def daily(scanned: DataFrame) -> DataFrame:
    """Scans, trackers, domains, mean score and risk distribution per day."""
    return tally_by(scanned.withColumn("scan_date", F.to_date("scan_timestamp")), "scan_date")


def weekly(scanned: DataFrame) -> DataFrame:
    """The same per week, from Monday."""
    week = F.to_date(F.date_trunc("week", "scan_timestamp"))
    return tally_by(scanned.withColumn("week", week), "week")


def trend(per_day: DataFrame) -> DataFrame:
    """Day-on-day change of the daily table.

    The window has no key, but its input is one row per day.
    """
    w = W.orderBy("scan_date")

    def change(name: str) -> Column:
        return F.col(name) - F.lag(name).over(w)

    return per_day.select(
        "scan_date",
        "mean_score",
        change("mean_score").alias("score_change"),
        "trackers",
        change("trackers").alias("tracker_change"),
        "domains",
        change("domains").alias("domain_growth"),
    )


def trending(per_day: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Each day's mean score against the mean of all scans before it."""
    before = W.orderBy("scan_date").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum(F.col("mean_score") * F.col("pages")).over(before)
    baseline = F.try_divide(total, F.sum("pages").over(before))
    change = F.col("mean_score") - F.col("baseline")
    return per_day.withColumn("baseline", baseline).select(
        "scan_date",
        "mean_score",
        "baseline",
        F.when(F.col("baseline").isNull(), "unknown")
        .when(change > tolerance, "improving")
        .when(change < -tolerance, "degrading")
        .otherwise("stable")
        .alias("trending"),
    )


def against_baseline(current: DataFrame, historical: DataFrame) -> DataFrame:
    """Current mean score and tracker count per url against those of earlier scans.

    Both sides are one row per url before they meet.
    """

    def means(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.groupBy("url").agg(
            F.avg("privacy_score").alias(f"{prefix}_score"),
            F.avg("tracker_count").alias(f"{prefix}_trackers"),
        )

    joined = means(current, "current").join(means(historical, "baseline"), "url", "left")
    return joined.withColumn(
        "score_change", F.col("current_score") - F.col("baseline_score")
    ).withColumn("tracker_change", F.col("current_trackers") - F.col("baseline_trackers"))


# Rows of one key in one span of time that a single window holds.
SPAN_ROWS = 50_000


def previous(
    history: DataFrame,
    key: str,
    time: str,
    values: list[str],
    tie: list[str] | None = None,
    unit: str = "day",
    part: str | None = None,
) -> DataFrame:
    """Each row with the values of the row before it, as struct `previous`.

    The window runs within a key and a span of time, so a key with most of the rows is split over
    as many tasks as it has spans; a span with more than SPAN_ROWS rows of a key is cut further,
    by its count, into equal parts of its time. The rows are shuffled once for it. The first row of
    a part takes over the last one of the part before: only the outermost two rows of each part meet
    by key for that, and nothing is joined back. Rows without a key or a time are kept, and have no
    previous row.

    part names a stored column that rises with the time, of a table that is bucketed by key and
    part (`history.append_bucketed`). Then neither a count nor a shuffle of the rows is needed.
    """
    if part is None:
        parts, spans = _parts(history, key, time, unit), ["_span", "_part"]
    else:
        parts, spans = history, [part]
    row = F.struct(time, *values)
    # Rows are sorted in both branches below. With all columns in the order, rows that tie are equal
    # and it doesn't matter which of them is first.
    named = [time, *(tie or [])]
    order = [*named, *[_sortable(f) for f in history.schema.fields if f.name not in (key, *named)]]
    inside = W.partitionBy(key, *spans).orderBy(*order)
    # A flag from below the window: a filter by the key would go down through the window, and the
    # branches would no longer share its shuffle.
    whole = F.col(key).isNotNull() & F.col(time).isNotNull()
    marked = (
        parts.withColumn("_whole", whole)
        .withColumn("_inside", F.lag(row).over(inside))
        .withColumn("_last", F.lead(F.lit(True)).over(inside).isNull())
    )
    first = F.col("_whole") & F.col("_inside").isNull()
    rest = marked.filter(~first).withColumn("previous", F.when(F.col("_whole"), F.col("_inside")))
    outer = marked.filter(F.col("_whole") & (F.col("_inside").isNull() | F.col("_last")))
    carried = outer.withColumn(
        "previous", F.lag(row).over(W.partitionBy(key).orderBy(*spans, *order))
    ).filter(first)
    columns = [*history.columns, "previous"]
    return rest.select(*columns).unionByName(carried.select(*columns))


def _sortable(field) -> Column:
    """A column as a sort key; maps and variants, which have no order, as text."""
    kind = field.dataType.simpleString()
    column = F.col(f"`{field.name.replace('`', '``')}`")
    return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column


def _crowded(spans: DataFrame, key: str, time: str) -> DataFrame:
    """Spans with more than SPAN_ROWS rows of a key: their number and the ends of their time."""
    return (
        spans.groupBy(key, "_span")
        .agg(
            F.count("*").alias("_rows"),
            F.unix_micros(F.min(time).cast("timestamp")).alias("_from"),
            F.unix_micros(F.max(time).cast("timestamp")).alias("_to"),
        )
        .filter(F.col("_rows") > SPAN_ROWS)
    )


def _part_of(time: str) -> Column:
    """The part of a crowded span that a row is in; 0 in others."""
    share = (F.unix_micros(F.col(time).cast("timestamp")) - F.col("_from")) / (
        F.col("_to") - F.col("_from") + 1
    )
    return F.coalesce(F.floor(share * F.ceil(F.col("_rows") / SPAN_ROWS)), F.lit(0))


def _parts(history: DataFrame, key: str, time: str, unit: str) -> DataFrame:
    """Rows with the span of time they are in, and its part where a span has many rows of a key."""
    whole = F.col(key).isNotNull() & F.col(time).isNotNull()
    spans = history.withColumn("_span", F.date_trunc(unit, time))
    # Dealt out by an expression, both sides of the join are plain shuffles, of which a hot key can
    # be split at run time; what an aggregate has dealt out cannot.
    crowded = _crowded(spans.filter(whole), key, time).withColumn("_span", F.date_trunc(unit, "_span"))
    return (
        spans.join(crowded, [key, "_span"], "left")
        .withColumn("_part", _part_of(time))
        .select(*history.columns, "_span", "_part")
    )


def previous_by_key(
    history: DataFrame,
    key: str,
    time: str,
    values: list[str],
    tie: list[str] | None = None,
    unit: str = "day",
) -> DataFrame:
    """The rows of `previous`, for many keys of which few have more than SPAN_ROWS rows.

    A window runs within a key, and only those few are split: by spans of time, and a span with more
    than SPAN_ROWS rows by its count, into equal parts of its time. Rows are shuffled once, for that
    window. For the first rows of parts an aggregate finds the two outermost rows of each part, of the
    split keys only; of other keys no row is sorted or shuffled again, however far apart its rows are.
    Rows without a key or a time are kept, unshuffled, and have no previous row.
    """
    row = F.struct(time, *values)
    named = [time, *(tie or [])]
    order = [*named, *[_sortable(f) for f in history.schema.fields if f.name not in (key, *named)]]
    columns, spans = [*history.columns, "previous"], ["_span", "_part"]
    whole = F.col(key).isNotNull() & F.col(time).isNotNull()
    rows, split = _split_keys(history.filter(whole), key, time, unit)
    inside = F.lag(row).over(W.partitionBy(key, *spans).orderBy(*order))
    # a part's first row comes from below
    rest = rows.withColumn("previous", inside).filter("_span IS NULL OR previous IS NOT NULL")
    ends = split.groupBy(key, *spans).agg(
        F.min_by(F.struct(*history.columns), F.struct(*order)).alias("_first"),
        F.max_by(row, F.struct(*order)).alias("_last"),
    )
    carried = ends.withColumn("previous", F.lag("_last").over(W.partitionBy(key).orderBy(*spans)))
    none = history.filter(~whole).withColumn("previous", F.when(F.lit(False), row))
    return (
        rest.select(*columns)
        .unionByName(carried.select("_first.*", "previous"))
        .unionByName(none.select(*columns))
    )


def _split_keys(history: DataFrame, key: str, time: str, unit: str) -> tuple[DataFrame, DataFrame]:
    """All rows with span and part, which are null and 0 where the key isn't split; the split rows.

    What is broadcast, the split keys and the crowded spans, has at most a row for each SPAN_ROWS
    rows of the history. Without any the second table and its work fall away at run time.
    """
    hot = (
        history.groupBy(key)
        .agg(F.count("*").alias("_rows"))
        .filter(F.col("_rows") > SPAN_ROWS)
        .select(key, F.lit(True).alias("_hot"))
    )

    def spanned(how: str) -> DataFrame:
        span = F.when(F.col("_hot"), F.date_trunc(unit, time))
        return history.join(F.broadcast(hot), key, how).withColumn("_span", span)

    crowded = _crowded(spanned("inner"), key, time)

    def cut(rows: DataFrame) -> DataFrame:
        return (
            rows.join(F.broadcast(crowded), [key, "_span"], "left")
            .withColumn("_part", _part_of(time))
            .select(*history.columns, "_span", "_part")
        )

    return cut(spanned("left")), cut(spanned("inner"))


def is_change_alert(
    score_drop: float = 10, tracker_rise: float = 20, percent: bool = False
) -> tuple[Column, Column]:
    """Conditions on a row with `previous`: score drop and tracker rise, in points or percent."""
    drop = F.col("previous.privacy_score") - F.col("privacy_score")
    rise = F.col("tracker_count") - F.col("previous.tracker_count")
    if percent:
        drop = F.try_divide(drop * 100, F.col("previous.privacy_score"))
        rise = F.try_divide(rise * 100, F.col("previous.tracker_count"))
    return (
        F.coalesce(drop >= score_drop, F.lit(False)),
        F.coalesce(rise >= tracker_rise, F.lit(False)),
    )


def change_alerts(
    history: DataFrame,
    score_drop: float = 10,
    tracker_rise: float = 20,
    percent: bool = False,
    unit: str = "day",
    part: str | None = None,
) -> DataFrame:
    """Scans whose score fell, or tracker count rose, by the limit since the scan before.

    part is as in `previous`.
    """
    values = ["privacy_score", "tracker_count"]
    if part is None:
        rows = previous_by_key(history, "url", "scan_ts", values, ["result_hash"], unit)
    else:
        rows = previous(history, "url", "scan_ts", values, ["result_hash"], unit, part)
    fell, rose = is_change_alert(score_drop, tracker_rise, percent)
    return rows.withColumn("score_fell", fell).withColumn("trackers_rose", rose).filter(
        "score_fell OR trackers_rose"
    )
