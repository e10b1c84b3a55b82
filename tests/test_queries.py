"""Every registered query against DuckDB on the given tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import differences, duckdb_on

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duckdb_on(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    result = queries()[name](spark, FOLDER)
    sql = oracle_sql().get(name)
    if sql is None:
        assert result.count() > 0
    else:
        assert differences(result, con, sql) == []


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    result = entry(spark)
    assert result.count() > 0 and "master_id" in result.columns
