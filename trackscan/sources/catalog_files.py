"""Catalogue files: JSON and CSV export, CSV source, and the table of host patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackscan.sources import folders

# Header of the catalogue CSV.
CSV_COLUMNS = [
    "Tracker ID",
    "Name",
    "Category",
    "Risk Level",
    "Description",
    "Domains",
    "Pattern Count",
    "GDPR Relevant",
    "CCPA Relevant",
    "Data Types",
    "Evasion Techniques",
    "First Seen",
]


def _flag(name: str):
    return F.when(F.col(name), "True").otherwise("False")


def csv_rows(catalogue: DataFrame) -> DataFrame:
    """The catalogue with the CSV header; lists become text and patterns a number."""
    values = [
        F.col("tracker_id"),
        F.col("name"),
        F.col("category"),
        F.col("risk_level"),
        F.col("description"),
        F.array_join("domains", ";"),
        F.size("patterns"),
        _flag("gdpr_relevant"),
        _flag("ccpa_relevant"),
        F.array_join("data_types", ";"),
        F.array_join("evasion_techniques", ";"),
        F.date_format("first_seen", "yyyy-MM-dd"),
    ]
    return catalogue.select(*[v.alias(n) for v, n in zip(values, CSV_COLUMNS)])


def write_csv(catalogue: DataFrame, path: str) -> None:
    csv_rows(catalogue).write.mode("overwrite").option("header", True).option(
        "emptyValue", ""
    ).csv(path)


def write_json(catalogue: DataFrame, path: str) -> None:
    catalogue.drop("ord").write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Inverse of `write_csv`; an empty list field is an empty array."""
    schema = ", ".join(
        f"`{c}` {'int' if c == 'Pattern Count' else 'date' if c == 'First Seen' else 'string'}"
        for c in CSV_COLUMNS
    )
    raw = spark.read.schema(schema).option("header", True).csv(path)

    def items(name: str):
        text = F.coalesce(F.col(name), F.lit(""))
        return F.filter(F.split(text, ";"), lambda x: x != "")

    return raw.select(
        F.col("Tracker ID").alias("tracker_id"),
        F.col("Name").alias("name"),
        F.col("Category").alias("category"),
        F.col("Risk Level").alias("risk_level"),
        F.col("Description").alias("description"),
        items("Domains").alias("domains"),
        F.col("Pattern Count").alias("pattern_count"),
        (F.col("GDPR Relevant") == "True").alias("gdpr_relevant"),
        (F.col("CCPA Relevant") == "True").alias("ccpa_relevant"),
        items("Data Types").alias("data_types"),
        items("Evasion Techniques").alias("evasion_techniques"),
        F.col("First Seen").alias("first_seen"),
    )


def latest_patterns(rows: DataFrame) -> DataFrame:
    """The newest row per host of a pattern table, its JSON pattern list parsed.

    Grouping keeps one running maximum per host, so a host with most of the rows is reduced
    before the exchange; a window would sort all of them in one task.
    """
    return newest_rows(rows).withColumn("patterns", F.from_json("patterns", "array<string>"))


def newest_rows(rows: DataFrame) -> DataFrame:
    """One row per host, as it stands: the newest, ties by its other columns."""
    others = [c for c in rows.columns if c != "domain"]
    newest = F.max_by(F.struct(*others), F.struct("last_updated", *_tie_break(others)))
    return rows.groupBy("domain").agg(newest.alias("row")).select("domain", "row.*").select(*rows.columns)


def _tie_break(names: list[str]) -> list[str]:
    return [n for n in names if n != "last_updated"]


def _versions(spark: SparkSession, path: str) -> tuple[int, int]:
    """(newest whole version, newest that a writer has claimed); 0 if there is none."""
    whole = [int(n) for n in folders.names(spark, f"{path}/versions")]
    claimed = [int(n) for n in folders.names(spark, f"{path}/claims")]
    return max(whole, default=0), max(claimed, default=0)


def upsert_patterns(rows: DataFrame, path: str, recover: bool = False) -> int:
    """Bring rows into the stored pattern table, whose domain is unique; returns its version.

    Of a domain the newest row stays, whether it was there or comes now, so the same rows twice
    change nothing. The new version is written whole beside the table, its number is claimed by a
    file that only one writer can create, and a rename makes it the one that is read: readers see
    the old version or the new one. If another writer claims the number first, the rows are
    brought into what that one has made of the table. A number that was claimed and never
    published belongs to a writer that is at work or has died; recover=True passes over it.
    """
    spark = rows.sparkSession
    while True:
        now, claimed = _versions(spark, path)
        if claimed > now and not recover:
            raise RuntimeError(f"version {claimed} of {path} is being written; recover=True passes over it")
        both = rows
        if now:
            old = read_patterns(spark, path)
            both = old.unionByName(rows.select(*old.columns))
        staged = f"{path}/staged/{uuid.uuid4().hex}"
        newest_rows(both.filter("domain IS NOT NULL")).write.parquet(staged)
        number = max(now, claimed) + 1
        if folders.claim(spark, f"{path}/claims/{number:09d}"):
            folders.rename(spark, staged, f"{path}/versions/{number:09d}")
            for name in folders.names(spark, f"{path}/versions")[:-KEPT_VERSIONS]:
                folders.remove(spark, f"{path}/versions/{name}")
            return number
        folders.remove(spark, staged)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """The stored pattern table as its last upsert has left it."""
    now, _ = _versions(spark, path)
    if not now:
        raise FileNotFoundError(f"no version of a pattern table in {path}")
    return spark.read.parquet(f"{path}/versions/{now:09d}")


# Readers of the version before the newest can finish.
KEPT_VERSIONS = 3
