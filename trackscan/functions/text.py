"""Small text expressions shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(text: Column, size: int) -> Column:
    """The text, or its first characters and dots when it is longer."""
    dotted = F.concat(F.substring(text, 1, size), F.lit("..."))
    return F.when(F.length(text) > size, dotted).otherwise(text)


def dotted(text: Column, size: int) -> Column:
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def first_filled(first: Column, second: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), second)


def title(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def fingerprint(*cols: Column) -> Column:
    """Hash of a result; callers sort arrays first so that equal results hash alike."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def days_until(end: Column, as_of: Column) -> Column:
    """Whole days from one timestamp to another, counted by elapsed time."""
    return F.floor((F.unix_micros(end) - F.unix_micros(as_of)) / F.lit(86_400_000_000)).cast("int")
