"""The training-data queries that SQL can express, against DuckDB on the smallest tables."""

import os

import pytest

from varlens.llm.queries import oracle_sql, queries

DATA = os.environ.get("VARLENS_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got, want = queries()[name](spark, DATA), con.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    pick = lambda rows, names: sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in rows), key=repr)
    assert pick(got.collect(), got.columns) == pick(want.fetchall(), list(want.columns))


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
