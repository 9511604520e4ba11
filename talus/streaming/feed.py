"""Conditions as a stream: beyond what batch checks need, for feeds that never end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "1 day", late: str = "2 hours", stamp: str = "ts") -> DataFrame:
    """Counts and extremes of each kind of reading in each window; state older than the watermark is dropped.

    Works on a stream and on a table alike.
    """
    e = events.withColumn("_at", F.col(stamp).cast("timestamp")).withWatermark("_at", late)
    g = e.groupBy(F.window("_at", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"), F.min("value").alias("low"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "high", "low")


def latest(events: DataFrame, late: str = "2 hours", stamp: str = "ts") -> DataFrame:
    """Each reading once, however often its source repeats it within the watermark."""
    return events.withColumn("_at", F.col(stamp).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(["event_id"])
