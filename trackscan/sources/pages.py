"""Reading crawl snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = (
    "struct<response_time:double,status_code:int,content_length:bigint,"
    "headers:map<string,string>,redirects:int,final_url:string,error:string>"
)
PAGE_SCHEMA = "page_id bigint, url string, html string"
PAGE_WITH_METRICS_SCHEMA = f"{PAGE_SCHEMA}, metrics {METRICS}"

# Below this much input per core a scan is spread out before the regular expressions run.
SPREAD_BELOW_BYTES = 16 << 20


def read_pages(
    spark: SparkSession,
    path: str,
    file_format: str = "parquet",
    schema: str | None = None,
) -> DataFrame:
    """A crawl snapshot; with the metrics schema it also carries the fetch metrics."""
    reader = spark.read.schema(schema) if schema else spark.read
    return spread(reader.format(file_format).load(path))


def plan_size(df: DataFrame) -> int:
    """Spark's own size estimate of a plan, taken from file sizes; reads no data."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def spread(pages: DataFrame) -> DataFrame:
    """Give every core a share of a small snapshot.

    A small snapshot is one file with one row group, which one core would lex alone. Only
    input below the limit is moved, so a large crawl is never shuffled: it has splits enough.
    Rows are dealt out in turn, so repeated page numbers do not meet in one task.
    """
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if plan_size(pages) >= cores * SPREAD_BELOW_BYTES:
        return pages
    return pages.repartition(cores)


def fetched(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("error").isNull())


def failed(scanned: DataFrame) -> DataFrame:
    """Failed pages keep their id and address next to the error text."""
    return scanned.filter(F.col("error").isNotNull()).select("page_id", "url", "error")
