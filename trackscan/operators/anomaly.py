"""Values far above the mean of their metric."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2.0


def zscores(rows: DataFrame, metric: str, value: str, limit: float = LIMIT) -> DataFrame:
    """Each row with its z-score within its metric, and whether it is above the limit.

    Mean and spread come from an aggregate that joins back, not from a window: a metric with
    most of the rows would otherwise be sorted and held by one task. The join has no hint: at run
    time few metrics become a broadcast, and of many a hot one is split. A metric without spread
    has no anomalies. Nothing runs before the result is asked for.
    """
    stats = rows.groupBy(F.col(metric).alias("_metric")).agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_spread")
    )
    score = F.when(F.col("_spread") == 0, 0.0).otherwise(
        (F.col(value) - F.col("_mean")) / F.col("_spread")
    )
    return (
        rows.join(stats, F.col(metric).eqNullSafe(F.col("_metric")))
        .withColumn("z_score", score)
        .withColumn("is_anomaly", F.coalesce(F.col("z_score") > limit, F.lit(False)))
        .drop("_metric", "_mean", "_spread")
    )


def scan_anomaly(values: Column, limit: float = LIMIT) -> Column:
    """Whether any metric of one scan stands out among all metrics of that scan.

    values, mean and spread are bound one after the other, so each is worked out once a row. Written
    into one another they would be worked out anew for each metric, and within that for each again.
    """

    def stands_out(vs: Column) -> Column:
        n = F.size(vs)

        def beyond(mean: Column) -> Column:
            square = F.aggregate(vs, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
            return _bound(
                square, lambda s: (s > 0) & F.exists(vs, lambda v: v - mean > F.lit(limit) * F.sqrt(s))
            )

        return (n > 0) & _bound(F.aggregate(vs, F.lit(0.0), lambda a, v: a + v) / n, beyond)

    return _bound(values, stands_out)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once, however often use names it."""
    return F.transform(F.array(value), use)[0]
