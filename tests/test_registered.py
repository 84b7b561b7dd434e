"""Every registered query with SQL against DuckDB, on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_names_agree():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    assert compare(spark, con, name, entry.queries()[name], SQL[name], data) == ""


def test_entry_has_rows(spark, data):
    assert entry.entry(spark).count() > 0
