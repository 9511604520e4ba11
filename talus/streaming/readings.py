"""Readings that expire: what is known of a place at a time, as a stream with state and as a table.

A reading is of a kind and a place, places being one where they agree to three decimals. It is
known for ``ttl_s`` seconds; one that failed is never kept, and doesn't displace what is known.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

OUT = "place string, kind string, reading_id long, at timestamp, known double, age_s long"


def keyed(readings: DataFrame) -> DataFrame:
    """(place, kind, reading_id, at, value) of readings (reading_id, kind, lat, lng, at, ok, value); value is NULL of failed ones."""
    place = F.concat_ws(",", *[F.round(F.col(c) * 1000).cast("long").cast("string") for c in ("lat", "lng")])  # in thousandths of a degree
    return readings.select(place.alias("place"), "kind", "reading_id", F.col("at").cast("timestamp").alias("at"), F.when(F.col("ok"), F.col("value").cast("double")).alias("value"))


def known(readings: DataFrame, ttl_s: int) -> DataFrame:
    """For each reading what is known of its place and kind when it comes in, itself included, and how old that is; NULL where nothing is."""
    by = Window.partitionBy("place", "kind").orderBy("at", "reading_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("value").isNotNull(), F.struct("at", "value")), ignorenulls=True).over(by)
    seen = keyed(readings).withColumn("_last", last)
    age = F.unix_timestamp("at") - F.unix_timestamp("_last.at")
    fresh = age < ttl_s
    return seen.select("place", "kind", "reading_id", "at", F.when(fresh, F.col("_last.value")).alias("known"), F.when(fresh, age).alias("age_s"))


def _keeper(ttl_s: int):
    """What a micro-batch of one key gives, and the last good reading that is kept of it, with the time it goes."""

    def told(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new, now = pd.concat(list(rows)).sort_values(["at", "reading_id"]), time.time()
        held = state.get if state.exists and state.get[2] > now else None  # its time may be over though rows came first
        before, out = held, []
        for reading, at, value in zip(new["reading_id"], new["at"], new["value"]):
            second = int(at.timestamp())
            if not pd.isna(value):
                held = (second, float(value), now + ttl_s)
            age = second - held[0] if held else None
            fresh = age is not None and age < ttl_s
            out.append((key[0], key[1], reading, at, held[1] if fresh else None, age if fresh else None))
        if held is None:
            if state.exists:
                state.remove()
        else:
            if held is not before:
                state.update(held)
            state.setTimeoutDuration(max(1, int((held[2] - now) * 1000)))
        yield pd.DataFrame(out, columns=["place", "kind", "reading_id", "at", "known", "age_s"]).astype({"known": "float64", "age_s": "Int64"})

    return told


def stream_known(readings: DataFrame, ttl_s: int) -> DataFrame:
    """known() of a stream whose readings come in the order of their times.

    A key's state is one reading; it is gone ``ttl_s`` seconds after it was stored.
    """
    return keyed(readings).groupBy("place", "kind").applyInPandasWithState(_keeper(ttl_s), OUT, "at_s long, value double, until double", "append", GroupStateTimeout.ProcessingTimeTimeout)
