"""Every report equals its plain SQL on the sample data."""

import pytest

import __spark_entry__ as driver
from compare import connect, difference

FOLDER = "/root/testdata/sf0.01"
SQL = driver.oracle_sql()
QUERIES = {name: driver.queries()[name] for name in driver.REPORTS}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(name, spark, con):
    assert difference(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 5
