"""Every registered query runs on the smallest tables and agrees with its SQL."""

import os

import duckdb
import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no example tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in compare.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["row_id", "score"] and df.count() == 20


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    outcome = compare.compare(spark, name, SMALL, con)
    assert outcome.startswith(("ok", "rows-only")), outcome
