"""Every registered query against its checking SQL on the smallest tables."""

import pytest
from conftest import SMALL
from oracle import check, connect

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert check(df, duck, SQL[name]) > 0
    else:
        assert df.count() > 0


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["event_id", "user_id", "event_type", "value"]
    assert df.count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_approximate_profile_is_close(spark):
    from tallyframe.operators.profile import profile_columns, profile_columns_approx

    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    exact = {r.column: r.unique_count for r in profile_columns(orders).collect()}
    for row in profile_columns_approx(orders).collect():
        assert abs(row.unique_count - exact[row.column]) <= 0.1 * exact[row.column] + 1
