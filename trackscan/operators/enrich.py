"""Domain enrichment from a prepared table of registration and name records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackscan.functions.urls import netloc


def domain_analysis(urls: DataFrame, domain_info: DataFrame) -> DataFrame:
    """One row per distinct host of the `url` column and record of it; a host without a record gets an error.

    Hosts are made distinct before the join, so a host behind most of the addresses is one
    row by then. A host with several records has a row for each.
    """
    hosts = urls.select(netloc(F.col("url")).alias("domain")).distinct()
    known = domain_info.withColumn("_known", F.lit(True))
    return (
        hosts.join(known, "domain", "left")
        .withColumn("error", F.when(F.col("_known").isNull(), "no record"))
        .drop("_known")
    )
