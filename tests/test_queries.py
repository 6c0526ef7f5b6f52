import pytest
from compare import assert_same, database

import __spark_entry__ as entry
from wayledger.plans.catalog import CATALOG


@pytest.fixture(scope="module")
def con(data):
    return database(data)


@pytest.mark.parametrize("name", [n for n in CATALOG.queries if n in CATALOG.sql])
def test_agrees_with_sql(spark, data, con, name):
    assert_same(CATALOG.queries[name](spark, data), con, CATALOG.sql[name])


@pytest.mark.parametrize("name", [n for n in CATALOG.queries if n not in CATALOG.sql])
def test_runs(spark, data, name):
    assert CATALOG.queries[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns
    assert entry.queries().keys() >= entry.oracle_sql().keys()
