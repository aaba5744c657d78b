"""A corpus pipeline of five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackscan.llm import mixing, packing, quality, secrets, simhash
from trackscan.llm.common import saved, table

VOCABULARY = "word_bpe_49k.json"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).filter("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: fingerprints of shingles of four words that
    differ in at most four bits, as op7 links them."""
    return simhash.representatives(docs, max_bits=4, shingle_words=4).select(*COLUMNS)


def secrets_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    found = secrets.without_secrets(docs.select(*COLUMNS), secrets.fit(docs))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def in_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in the order of the curriculum."""
    kept = mixing.mixed(docs, whole=True, keep=("text", "lang", "n_chars"))
    return kept.select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences."""
    return packing.packed(docs, VOCABULARY)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each),
    ("secrets", secrets_removed),
    ("mixing", in_training_order),
    ("packing", packed),
]

#: Fingerprints, networks and tokenizers have no form in SQL; tests/llm has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
