"""Every registered query against its check SQL, and the contract of the entry module."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

CHECKS = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    connection = connect(sf)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, sf, con, name):
    problems = compare(spark, con, sf, name, QUERIES[name], CHECKS[name])
    assert [p for p in problems if p != "no rows"] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "avg_daily_pickups" in df.columns


def test_every_check_has_a_query():
    assert set(CHECKS) <= set(QUERIES)
