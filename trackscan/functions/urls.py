"""URL parts by regular expression.

The built-in URL parser drops ports and user names and gives nothing for hosts with an
underscore; these keep the text between the separators as it stands.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def with_scheme(url: Column) -> Column:
    has_scheme = url.startswith("http://") | url.startswith("https://")
    return F.when(has_scheme, url).otherwise(F.concat(F.lit("https://"), url))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, NETLOC, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, QUERY, 1)


def is_https(url: Column) -> Column:
    return F.startswith(F.lower(url), F.lit("https://"))


def query_keys(url: Column) -> Column:
    """Distinct decoded parameter names of a URL; parameters without a value do not count."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    raw = F.transform(pairs, lambda p: F.regexp_extract(p, "(?s)^([^=]*)=", 1))
    decoded = F.transform(raw, lambda k: F.coalesce(F.try_url_decode(k), k))
    return F.array_distinct(decoded)
