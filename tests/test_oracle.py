"""Every registered query against its SQL twin, whole results."""

import pytest
from compare import difference, duck_rows, spark_rows
from logweave.plans import load_queries

QUERIES, SQL = load_queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf, name):
    assert difference(spark_rows(QUERIES[name](spark, sf)), duck_rows(con, SQL[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
