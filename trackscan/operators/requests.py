"""Request-log analysis: tracking parameters and pixel-like requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackscan.functions import urls

# Parameter names that carry tracking ids, and endings of image paths.
TRACKING_PARAMETERS = "utm_|fbclid|gclid|_ga|mc_eid"
IMAGE_ENDINGS = (".gif", ".png", ".jpg")


def tracking_parameters(requests: DataFrame) -> DataFrame:
    """One row per request and tracking parameter in its address."""
    # Requests without a query cannot match; they leave before any parsing.
    return (
        requests.filter(F.col("url").contains("?"))
        .select("page_id", "url", F.explode(urls.query_keys(F.col("url"))).alias("parameter"))
        .filter(F.lower("parameter").rlike(TRACKING_PARAMETERS))
    )


def pixel_requests(requests: DataFrame) -> DataFrame:
    """Image requests with `pixel` in the address, as tracker rows."""
    url = F.col("url")
    path = urls.path(url)
    image = F.lit(False)
    for ending in IMAGE_ENDINGS:
        image = image | path.endswith(ending)
    return requests.filter(F.lower(url).contains("pixel") & image).select(
        "page_id",
        F.lit("tracking_pixel").alias("tracker_type"),
        urls.netloc(url).alias("domain"),
        url.alias("source"),
        F.lit("analytics").alias("category"),
        F.lit("medium").alias("risk_level"),
        F.lit("page_tracking").alias("purpose"),
        F.lit("pixel_request").alias("method"),
    )
