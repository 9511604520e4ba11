"""Operators that SQL can express, beside their SQL."""

import pytest
from tests_compare import connect, difference

from talus import llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_operator_equals_sql(spark, name):
    why, rows = difference(spark, connect(SF), SF, llm.queries()[name], llm.oracle_sql()[name])
    assert why is None and rows


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_queries_have_rows(spark, name):
    df = llm.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
