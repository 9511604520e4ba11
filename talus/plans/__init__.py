"""Queries over the supplied tables, and the same results as SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talus.shipping import shipped
from talus.sources.views import with_views

from . import conditions, ratings, records, spatial

_MODULES = [ratings, spatial, conditions, records]


def _sent(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shipped(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _sent(f) for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for m in _MODULES for name, sql in m.SQL.items()}
