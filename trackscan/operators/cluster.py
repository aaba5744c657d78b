"""Clusters of host names by their spelling."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, NGram, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackscan.streaming.streams import shared_folder

FEATURES, PARTS = 128, 64
#: Most hosts that centres are fitted on, by a hash of the name; every host is given a cluster.
SAMPLE = 200_000


class Clusters(NamedTuple):
    """hosts has (domain, features, cluster); a cluster's number is its place in centres."""

    hosts: DataFrame
    centres: list[list[float]]


def fit(domains: DataFrame, k: int = 5, seed: int = 42, n: int = 3, sample: int = SAMPLE) -> Clusters:
    """Clusters of the distinct values of the `domain` column, empty ones and nulls left out.

    Fewer than k hosts form one cluster, without a centre. Features are hashed character n-grams,
    which need no fitted vocabulary. The hosts are written to the shared folder, since counting,
    fitting and labelling would each go back to the pages.
    """
    spark = domains.sparkSession
    path = shared_folder(spark, "hosts")
    domains.select("domain").filter(F.col("domain") != "").distinct().write.parquet(path)
    hosts = spark.read.parquet(path)
    padded = F.concat(F.lit("^" * (n - 1)), F.lower("domain"), F.lit("$" * (n - 1)))
    grams = NGram(n=n, inputCol="chars", outputCol="grams")
    counts = HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="tf")
    unit = Normalizer(inputCol="tf", outputCol="features")

    def features(rows: DataFrame) -> DataFrame:
        chars = rows.withColumn("chars", F.split(padded, ""))
        return unit.transform(counts.transform(grams.transform(chars))).select("domain", "features")

    if hosts.limit(k).count() < k:
        return Clusters(features(hosts).withColumn("cluster", F.lit(0)), [])
    # Sorted parts of a fixed number fix the row order that the seeded start of the clustering
    # depends on, whatever the session's number of partitions.
    drawn = (
        hosts.orderBy(F.xxhash64("domain"), "domain")
        .limit(sample)
        .repartition(PARTS, "domain")
        .sortWithinPartitions("domain")
    )
    means = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")
    model = means.fit(features(drawn))
    centres = [[float(v) for v in c] for c in model.clusterCenters()]
    return Clusters(model.transform(features(hosts)), centres)


def distances(features: Column, centres: list[list[float]]) -> Column:
    """Squared distances of a feature vector to each centre, in their order."""
    values = vector_to_array(features)
    apart = [
        F.aggregate(
            F.zip_with(values, F.lit(centre), lambda x, c: (x - c) * (x - c)),
            F.lit(0.0),
            lambda total, square: total + square,
        )
        for centre in centres
    ]
    return F.array(*apart)


def cluster_domains(
    domains: DataFrame, k: int = 5, seed: int = 42, n: int = 3, sample: int = SAMPLE
) -> DataFrame:
    """(domain, cluster) for the distinct values of the `domain` column, as `fit` finds them."""
    return fit(domains, k, seed, n, sample).hosts.select("domain", "cluster")
