import pytest

import __spark_entry__ as registered

from .oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", registered._own_queries())
def test_query_agrees_with_sql(spark, connection, key):
    assert differences(spark, connection, SF_DIR, key) is None


def test_every_query_has_sql():
    assert set(registered._own_queries()) == set(registered._own_sql())
    assert set(registered.oracle_sql()) <= set(registered.queries())


def test_entry_returns_cleaned_orders(spark):
    result = registered.entry(spark)
    assert result.columns == ["order_id", "customer_id", "amount", "order_ts"]
    assert result.count() == 1484
