"""Every query with SQL gives what DuckDB gives on the same tables."""

import pytest

from talus import plans
from tests_compare import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.queries(), plans.oracle_sql()
#: Queries whose answer can be empty at this size.
MAY_BE_EMPTY = {"stitch_pairs", "components"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    why, rows = difference(spark, con, SF, QUERIES[name], ORACLES[name])
    assert why is None
    assert rows or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
