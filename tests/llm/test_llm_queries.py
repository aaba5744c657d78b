"""The registered queries of the subpackage over a whole small data set."""

import duckdb
import pytest

from trackscan.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    found = queries.QUERIES[name](spark, SF).toPandas()
    assert len(found)
    if name in queries.SQL:
        with duckdb.connect() as db:
            for table in ("documents", "embeddings", "benchmark"):
                db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
            want = db.execute(queries.SQL[name]).df()
        columns = sorted(found.columns)
        assert columns == sorted(want.columns)
        rows = [sorted(x[columns].astype(str).itertuples(index=False)) for x in (found, want)]
        assert rows[0] == rows[1]


def test_entry_registers_them():
    import __spark_entry__ as contract

    assert {*queries.QUERIES, "pipeline"} <= contract.queries().keys()
