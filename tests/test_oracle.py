"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, spark_rows, sql_rows

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, con, folder, name):
    names, rows = spark_rows(QUERIES[name](spark, folder))
    assert rows
    if name in ORACLE:
        expected_names, expected = sql_rows(con, ORACLE[name])
        assert names == expected_names
        assert rows == expected


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
