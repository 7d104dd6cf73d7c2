"""Every registered query with SQL text gives exactly the rows DuckDB gives."""

import pytest

import __spark_entry__ as entry
from tests.harness import compare, duck

TEXTS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_query(spark, data, con, name):
    compare(entry.queries()[name](spark, data), con, TEXTS[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_registered():
    assert set(TEXTS) <= set(entry.queries())
