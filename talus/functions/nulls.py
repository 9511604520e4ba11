"""Three states: NULL is unknown, an empty value is known to be nothing, a value is a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of "no value", by source
FOREST_NULLS = ["", "none", "n/a", "na", "null", "unknown"]
PARK_NULLS = ["", "none", "n/a", "null", "unknown", "not specified"]
SITE_NULLS = ["", "none", "n/a", "na", "null", "unknown", "no data", "nan", "not specified"]


def clean(text: Column, spellings: list[str] = FOREST_NULLS) -> Column:
    """Trimmed text, NULL for any of the spellings whatever their case."""
    trimmed = F.trim(text)
    return F.when(~F.lower(trimmed).isin(spellings), trimmed)


def finite(value: Column) -> Column:
    """A double, NULL for what isn't a finite number."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def within(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Closed range with open-ended sides; unknown never matches once a bound is given."""
    if low is None and high is None:
        return F.lit(True)
    test = value.isNotNull()
    if low is not None:
        test &= value >= low
    if high is not None:
        test &= value <= high
    return test


def unknown_or(value: Column, test: Column) -> Column:
    """True for unknown values: for seasons and fires, silence isn't evidence of absence."""
    return value.isNull() | test
