"""Site-verification and social meta tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackscan.fixed_values import VERIFICATION_META
from trackscan.functions.lex import attribute
from trackscan.functions.text import first_filled

# Property prefixes of social cards.
SOCIAL_PREFIXES = ("og:", "twitter:", "fb:")


def metas(elements: Column, with_source: bool = True) -> Column:
    """Meta rows of a page; a verification tag is never also a social one."""
    none = F.lit(None).cast("string")

    def read(e: Column) -> Column:
        return F.struct(
            F.lower(attribute(e["attrs"], "name")).alias("name"),
            F.lower(attribute(e["attrs"], "property")).alias("property"),
            attribute(e["attrs"], "content").alias("content"),
            e["source"].alias("source"),
        )

    def row(m: Column) -> Column:
        verification = m["name"].isin(VERIFICATION_META) | m["property"].isin(VERIFICATION_META)
        social = F.lit(False)
        for prefix in SOCIAL_PREFIXES:
            social = social | m["property"].startswith(prefix)
        kind = F.when(verification, "verification_meta").when(social, "social_meta")
        return F.struct(
            kind.alias("type"),
            F.when(verification, first_filled(m["name"], m["property"])).alias("name"),
            F.when(~verification, m["property"]).alias("property"),
            m["content"].alias("content"),
            (m["source"] if with_source else none).alias("element"),
        )

    found = F.filter(elements, lambda e: (e["tag"] == "meta") & ~e["in_noscript"])
    rows = F.transform(F.transform(found, read), row)
    return F.filter(rows, lambda r: r["type"].isNotNull())
