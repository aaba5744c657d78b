"""Mix sources to target weights along a curriculum whose weights change over training.

Every source has a schedule: its weight at moments of training, straight lines between them. Its
integral, scaled to the source's target, is the words that the source has given by any moment.
Turned around, that gives each document the moment at which its place in the source's stream comes
up; a stream that is used more than once gives its documents several positions. Documents are put
in order of position by a range sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by a source's place among the sources, repeating; (moment, weight) of the schedules.
WEIGHTS = (3, 1, 2)
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)),
)
BUDGET, MOST_REPEATS = 1.5, 2
#: Parts that a source's stream is cut into to add up its sizes; part sums, not rows, meet.
PARTS = 1024
SEED = 11


def words(text: str | Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, budget: float = BUDGET, most: float = MOST_REPEATS) -> DataFrame:
    """sources (source, source_size, weight) with target added.

    Targets share budget * all sizes by weight, but none is above most * its size: what is above
    goes to the others by weight, until none is. That ends at min(most * size, level * weight)
    for one level: with sources in order of size over weight, those before some place are full
    and the level of the others follows from what is left. One row for each source meets in one
    task. A source of weight 0, or of size 0, gets 0.
    """
    total = Window.partitionBy()
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    live = (F.col("weight") > 0) & (F.col("source_size") > 0)
    left = budget * F.sum("source_size").over(total) - F.coalesce(
        most * F.sum("source_size").over(upto), F.lit(0.0)
    )
    level = sources.filter(live).select(
        "source",
        "source_size",
        "weight",
        F.row_number().over(full).alias("n"),
        (left / F.sum("weight").over(after)).alias("level"),
    )
    # the first source that its level doesn't fill sets the level of all from there on
    most_words = most * F.col("source_size").cast("double")
    fits = F.col("level") * F.col("weight") <= most_words
    first = F.min(F.when(fits, F.struct("n", "level"))).over(total)
    level = level.withColumn("set", first["level"]).withColumn(
        "target", F.coalesce(F.least(F.col("set") * F.col("weight"), most_words), most_words)
    )
    return level.select("source", "source_size", "weight", "target").union(
        sources.filter(~live).select("source", "source_size", "weight", F.lit(0.0))
    )


def by_rank(sources: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """sources with place (by code point, null last, from 0) and weight (weights, repeating)."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*(F.lit(float(w)) for w in weights))
    return sources.withColumn("place", place).withColumn(
        "weight", F.get(listed, F.col("place") % len(weights))
    )


def moment(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The moment by which the schedule has used share (0 to 1) of its integral.

    Between two moments the integral is a parabola; its inverse is taken in closed form. Over a
    stretch of weight 0 it is the stretch's end.
    """
    areas, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        areas.append((t0, t1, w0, w1, done))
        done += (t1 - t0) * (w0 + w1) / 2
    if done <= 0:
        raise ValueError("a schedule needs an integral above 0")
    need = share * done
    result = F.lit(float(schedule[-1][0]))
    for t0, t1, w0, w1, before in reversed(areas):
        area = (t1 - t0) * (w0 + w1) / 2
        if area <= 0:
            continue
        slope = (w1 - w0) / (t1 - t0)
        ask = F.greatest(need - before, F.lit(0.0))
        root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * ask, F.lit(0.0)))
        inner = t0 + F.when(w0 + root > 0, 2 * ask / (w0 + root)).otherwise(0.0)
        result = F.when(need <= before + area, F.least(inner, F.lit(float(t1)))).otherwise(result)
    return result


def assign(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    budget: float = BUDGET,
    most: int = MOST_REPEATS,
    whole: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows (*keep, doc_id, source, size, source_size, target, taken, copies), one a row of docs.

    A source's documents stand in one stream, in the order of a hash of doc_id and text (then doc_id,
    size and text), so rows without an id are spread as any others are. The stream is used again from its start until the target is met; so reruns agree and
    repeated rows each have a place. taken is the words that the mix takes, over all copies. The
    copy at the target is cut there; with whole it is taken whole if its middle comes before the
    target, and left out otherwise. copies holds (position, words) of each copy with words,
    position from 0 to 1; it is empty for documents that aren't taken or have no words. A null
    source is a source. Sizes are added up in parts of a stream, so a source with most of the
    rows is spread over PARTS tasks.
    """
    place = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), "text")
    rows = docs.select(
        *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        words("text").alias("size"),
        place.alias("place"),
        F.xxhash64("text").alias("tie"),
        # parts follow the order of place
        F.shiftrightunsigned(place, 64 - (PARTS - 1).bit_length()).alias("part"),
    ).withColumn("no_source", F.col("source").isNull())
    rows = rows.withColumn("source_key", F.coalesce("source", F.lit("")))
    key = ["no_source", "source_key"]
    parts = rows.groupBy(*key, "part").agg(F.sum("size").alias("words"))
    within = Window.partitionBy(*key).orderBy("part")
    parts = parts.withColumn("before", F.sum("words").over(within) - F.col("words"))
    sources = parts.groupBy(*key).agg(F.sum("words").alias("source_size"))
    named = sources.select(
        F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "source_size"
    )
    aims = (
        targets(by_rank(named, weights).drop("place"), budget, most)
        .withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .select(
            F.col("source").isNull().alias("no_source"),
            F.coalesce("source", F.lit("")).alias("source_key"),
            "source_size",
            "target",
            (F.col("turn") - 1).alias("turn"),
        )
    )
    order = Window.partitionBy(*key, "part").orderBy("place", "doc_id", "size", "tie")
    found = (
        rows.join(parts.join(aims, key).drop("words"), [*key, "part"])
        .withColumn("start", F.col("before") + F.sum("size").over(order) - F.col("size"))
        .withColumn("goal", F.floor(F.col("target") + 0.5))
    )

    def copy(epoch: Column) -> Column:
        at = epoch * F.col("source_size") + F.col("start")
        left = F.greatest(F.least(F.col("goal") - at, F.col("size")), F.lit(0))
        if whole:
            left = F.when(left * 2 > F.col("size"), F.col("size")).otherwise(0)
        share = (at + left / 2) / F.col("target")
        share = F.least(share, F.lit(1.0))
        position = F.coalesce(
            *(
                F.when(F.col("turn") % len(schedules) == i, moment(share, s))
                for i, s in enumerate(schedules)
            )
        )
        return F.struct(position.alias("position"), left.cast("long").alias("words"))

    epochs = F.sequence(F.lit(0), F.lit(int(most)))
    copies = F.filter(F.transform(epochs, copy), lambda x: x["words"] > 0)
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(
        F.array().cast("array<struct<position:double,words:bigint>>")
    )
    total = F.aggregate("copies", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return found.withColumn("copies", copies).select(
        *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)),
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        total.alias("taken"),
        "copies",
    )


def mixed(docs: DataFrame, whole: bool = False, keep: Sequence[str] = (), **options) -> DataFrame:
    """Rows (*keep, doc_id, source, position, words), one a copy, in ranges of position."""
    rows = assign(docs, whole=whole, keep=keep, **options)
    copies = rows.select(*keep, "doc_id", "source", F.explode("copies").alias("copy"))
    return copies.select(*keep, "doc_id", "source", "copy.position", "copy.words").orderBy(
        "position", "doc_id"
    )
