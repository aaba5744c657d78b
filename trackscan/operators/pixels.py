"""Tracking-pixel rules on the element array of a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackscan.fixed_values import TRACKER_DOMAINS
from trackscan.functions.lex import attribute
from trackscan.functions.match import first_domain
from trackscan.functions.text import cut

# Words in a source address that suggest tracking.
TRACKING_WORDS = "utm_|track|pixel|beacon|analytics|event|campaign"


def is_one_pixel(width: Column, height: Column, style: Column) -> Column:
    """1x1, 0x0, or a style that says 1px with exactly this spacing."""
    return (
        ((width == "1") & (height == "1"))
        | ((width == "0") & (height == "0"))
        | style.contains("width: 1px")
        | style.contains("height: 1px")
    )


def has_tracking_word(src: Column) -> Column:
    return F.lower(src).rlike(TRACKING_WORDS)


def is_base64_pixel(tag: Column, src: Column, width: Column, height: Column) -> Column:
    small = ((width == "1") & (height == "1")) | (F.length(src) < 200)
    return (tag == "img") & src.contains("data:image") & src.contains("base64") & small


def _images(elements: Column) -> Column:
    """Images and frames with the four attributes the rules read."""
    found = F.filter(elements, lambda e: e["tag"].isin("img", "iframe"))
    return F.transform(
        found,
        lambda e: F.struct(
            e["tag"].alias("tag"),
            e["in_noscript"].alias("in_noscript"),
            attribute(e["attrs"], "src").alias("src"),
            attribute(e["attrs"], "width").alias("width"),
            attribute(e["attrs"], "height").alias("height"),
            attribute(e["attrs"], "style").alias("style"),
            e["source"].alias("source"),
        ),
    )


def pixels(
    elements: Column, domains: Sequence[str] = TRACKER_DOMAINS, with_source: bool = True
) -> Column:
    """Pixel rows of a page: document pass, noscript pass, then base64 images.

    An image inside noscript is in both of the first two passes and so counts twice, and a
    base64 image counts once more on top; the score depends on that.
    """

    def source(image: Column) -> Column:
        return image["source"] if with_source else F.lit(None).cast("string")

    def ordinary(image: Column) -> Column:
        src = image["src"]
        return F.struct(
            image["tag"].alias("element_type"),
            src.alias("src"),
            image["width"].alias("width"),
            image["height"].alias("height"),
            is_one_pixel(image["width"], image["height"], image["style"]).alias("is_1x1_pixel"),
            first_domain(src, domains).alias("tracking_domain"),
            has_tracking_word(src).alias("has_tracking_params"),
            image["in_noscript"].alias("in_noscript"),
            F.lit(None).cast("boolean").alias("is_base64"),
            F.lit(None).cast("string").alias("tracking_type"),
            source(image).alias("full_element"),
        )

    def likely(pixel: Column) -> Column:
        return (
            pixel["is_1x1_pixel"]
            | pixel["tracking_domain"].isNotNull()
            | pixel["has_tracking_params"]
            | pixel["in_noscript"]
        )

    def base64(image: Column) -> Column:
        return F.struct(
            image["tag"].alias("element_type"),
            cut(image["src"], 100).alias("src"),
            image["width"].alias("width"),
            image["height"].alias("height"),
            F.lit(None).cast("boolean").alias("is_1x1_pixel"),
            F.lit(None).cast("string").alias("tracking_domain"),
            F.lit(None).cast("boolean").alias("has_tracking_params"),
            F.lit(None).cast("boolean").alias("in_noscript"),
            F.lit(True).alias("is_base64"),
            F.lit("base64_pixel").alias("tracking_type"),
            source(image).alias("full_element"),
        )

    images = _images(elements)
    embedded = F.filter(
        images,
        lambda i: ~i["in_noscript"] & is_base64_pixel(i["tag"], i["src"], i["width"], i["height"]),
    )
    return F.concat(
        F.filter(F.transform(images, ordinary), likely), F.transform(embedded, base64)
    )
