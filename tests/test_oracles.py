"""Every named query against its SQL, on whole tables."""

import pytest
from compare import connect, spark_rows, sql_rows

import __spark_entry__ as entry
from telespark.plans.oracles import all_oracles
from telespark.plans.queries import all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf))
    expected_columns, expected_rows = sql_rows(con, ORACLES[name])
    assert columns == expected_columns
    assert rows == expected_rows


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 15
