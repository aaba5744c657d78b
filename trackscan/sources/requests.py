"""Request-log source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackscan.functions.lex import all_elements, attribute

REQUEST_SCHEMA = "page_id bigint, url string, resource_type string, headers map<string,string>"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def requests_of_pages(pages: DataFrame) -> DataFrame:
    """The log a crawl implies: the page itself and every source address on it."""
    sources = F.transform(
        all_elements(F.col("html")),
        lambda e: F.struct(
            attribute(e["attrs"], "src").alias("url"), e["tag"].alias("resource_type")
        ),
    )
    own = F.array(F.struct(F.col("url"), F.lit("document").alias("resource_type")))
    filled = F.filter(F.concat(own, sources), lambda r: r["url"] != "")
    return pages.select("page_id", F.inline(filled))
