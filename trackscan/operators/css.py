"""Background images that load from a tracker host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackscan.fixed_values import TRACKER_DOMAINS
from trackscan.functions.lex import attribute
from trackscan.functions.match import IGNORE_CASE, first_domain

# Fixed value: the address of a CSS background image.
BACKGROUND_URL = r"""background-image:\s*url\(["']?([^"')]+)["']?\)"""


def background_urls(css: Column) -> Column:
    return F.regexp_extract_all(css, F.lit(IGNORE_CASE + BACKGROUND_URL), F.lit(1))


def styles(
    elements: Column, domains: Sequence[str] = TRACKER_DOMAINS, with_source: bool = True
) -> Column:
    """CSS rows of a page: style elements first, then inline styles."""

    def rows(kind: str):
        def build(e: Column) -> Column:
            source = e["source"] if with_source else F.lit(None).cast("string")
            return F.transform(
                background_urls(e["css"]),
                lambda url: F.struct(
                    F.lit(kind).alias("type"),
                    url.alias("url"),
                    first_domain(url, domains).alias("domain"),
                    source.alias("element"),
                ),
            )

        return build

    page = F.filter(elements, lambda e: ~e["in_noscript"])
    sheets = F.transform(
        F.filter(page, lambda e: e["tag"] == "style"),
        lambda e: F.struct(e["body"].alias("css"), e["source"].alias("source")),
    )
    # The inline test is exact text while the address search ignores case.
    inline = F.filter(
        F.transform(
            F.filter(page, lambda e: e["source"].contains("background-image")),
            lambda e: F.struct(
                attribute(e["attrs"], "style").alias("css"), e["source"].alias("source")
            ),
        ),
        lambda s: s["css"].contains("background-image"),
    )
    found = F.concat(
        F.flatten(F.transform(sheets, rows("css_background"))),
        F.flatten(F.transform(inline, rows("inline_css_background"))),
    )
    return F.filter(found, lambda r: r["domain"].isNotNull())
