"""A ledger of tiles: which have been read, which were empty, which failed, and what is left to read.

Readers land rows (tile_id, status, attempt, at, elements) as files: status done with
elements, empty, or failed. The ledger keeps a row for each result; the last one of a
tile, by attempt and time, is the tile's state. A failed tile is never taken for an empty
one: it is read again, up to ``RETRIES`` times, and stays incomplete after that.

Ledger and elements are Parquet folders with a partition for each micro-batch, which is
overwritten when the batch is repeated, so a sweep that stops half-way goes on without
losing or doubling results.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RETRIES = 1
LEDGER = "tile_id string, status string, attempt int, at timestamp"


def states(ledger: DataFrame) -> DataFrame:
    """(tile_id, status, attempts, at): each tile's last result, and how often it was read."""
    last = F.max_by(F.struct("status", "at"), F.struct("attempt", "at", "status")).alias("l")
    return ledger.groupBy("tile_id").agg(last, F.count_distinct("attempt").cast("int").alias("attempts")).select("tile_id", "l.status", "attempts", "l.at")


def left(tiles: DataFrame, ledger: DataFrame, retries: int = RETRIES) -> DataFrame:
    """tiles (tile_id, ...) still to be read, with the number of the attempt: those without a result, and failed ones that have a retry left."""
    known = states(ledger).select("tile_id", F.col("status").alias("_status"), F.col("attempts").alias("_attempts"))
    met = tiles.join(known, "tile_id", "left")
    open_ = F.col("_status").isNull() | ((F.col("_status") == "failed") & (F.col("_attempts") <= retries))
    return met.filter(open_).withColumn("attempt", F.coalesce("_attempts", F.lit(0))).drop("_status", "_attempts")


def incomplete(tiles: DataFrame, ledger: DataFrame) -> DataFrame:
    """Tiles of the plan whose last result isn't done or empty: unread and failed ones."""
    read = states(ledger).filter(F.col("status").isin("done", "empty")).select("tile_id")
    return tiles.join(read, "tile_id", "left_anti")


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder's rows, none where it doesn't exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return _kept(spark, f"{path}/ledger", f"{LEDGER}, batch long")


def elements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements (tile_id, attempt, at, element) of tiles whose last result they came with, each (type, id) once, the one with most points."""
    rows = _kept(spark, f"{path}/elements", f"tile_id string, attempt int, at timestamp, element {schema}, batch long")
    last = states(ledger(spark, path)).filter("status = 'done'").select("tile_id", "at")
    one = rows.join(last, ["tile_id", "at"]).select("tile_id", "element.*")
    return one.groupBy("type", "id").agg(F.max_by(F.struct(*one.columns), F.struct("n_points", "tile_id")).alias("e")).select("e.*")


def keep(results: DataFrame, batch: int, path: str) -> None:
    """Writes a batch of results: its elements first, then the ledger rows that make them count."""
    results = results.persist()
    try:
        found = results.filter("status = 'done'").select("tile_id", "attempt", "at", F.explode("elements").alias("element"))
        found.write.mode("overwrite").parquet(f"{path}/elements/batch={batch}")
        results.select("tile_id", "status", "attempt", "at").write.mode("overwrite").parquet(f"{path}/ledger/batch={batch}")
    finally:
        results.unpersist()


def sweep(landed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Reads what has landed (a stream of result rows) into ledger and elements, each micro-batch once, and ends."""
    return landed.writeStream.foreachBatch(lambda rows, batch: keep(rows, batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
