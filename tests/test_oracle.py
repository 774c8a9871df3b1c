"""Every registered query against DuckDB on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from workload import all_queries

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
