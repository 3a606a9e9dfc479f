"""Every registered query against its SQL on the smallest scale factor."""

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from gleanset.fixtures import BASE_TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    frame = queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in frame.collect()]
    if name in oracle_sql():
        cursor = duck.execute(oracle_sql()[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(frame.columns)
        assert check.comparable(frame.columns, rows) == check.comparable(columns, cursor.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
