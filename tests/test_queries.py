"""The registered queries at the smallest scale, each against its SQL."""

import datetime
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as contract  # noqa: E402
from checks.query_set import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in ("pages", "events"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def plain(value):
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in order)) for r in cursor.fetchall())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and all(r.privacy_score <= 50 for r in rows)


def test_entry_has_all_queries():
    assert QUERIES.keys() <= contract.queries().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()
