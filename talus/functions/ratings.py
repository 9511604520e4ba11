"""Effort, steepness and activities of a trail; unknown inputs give unknown ratings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (exclusive) of the bands; the last band is open
DIFFICULTY = [(50, "easy"), (100, "moderate"), (150, "hard"), (200, "strenuous"), (None, "very strenuous")]
STEEPNESS = [(150, "gentle"), (300, "moderate"), (475, "steep"), (None, "very steep")]
MOTORISED = ["fourwd", "atv", "motorcycle", "snowmobile"]
OVERNIGHT_MILES = 8.0


def band(value: Column, bands: list) -> Column:
    """The label of the first band whose bound is above value; NULL for NULL."""
    out = F.lit(bands[-1][1])
    for bound, label in reversed(bands[:-1]):
        out = F.when(value < bound, label).otherwise(out)
    return F.when(value.isNotNull(), out)


def _rated(miles: Column, gain: Column, value: Column) -> Column:
    return F.when((miles > 0) & (gain >= 0), value)


def effort(miles: Column, gain: Column) -> Column:
    """Geometric mean of distance and twice the climb; round only for display, band before."""
    return _rated(miles, gain, F.sqrt(2 * gain * miles))


def climb_rate(miles: Column, gain: Column) -> Column:
    return _rated(miles, gain, gain / miles)


def allowed(uses: Column, kind: str) -> Column:
    """Known to be allowed: a missing use or record is not."""
    return F.coalesce(F.try_element_at(uses, F.lit(kind)), F.lit(False))


def activities(uses: Column, wilderness: Column, miles: Column) -> dict[str, Column]:
    """Predicates over a map from use to allowed. Hiking means: not known to be a road."""
    motor = reduce(lambda a, b: a | b, [allowed(uses, k) for k in MOTORISED])
    return {
        "hiking": ~motor,
        "backpacking": ~motor & (wilderness.isNotNull() | (F.coalesce(miles, F.lit(0.0)) >= OVERNIGHT_MILES)),
        "bike": allowed(uses, "bike"),
        "horse": allowed(uses, "horse"),
        "motorized": motor,
    }
