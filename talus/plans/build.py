"""The batch build: stages that each add columns, skip or fail alone, and resume from what is stored.

A stage is DataFrame -> DataFrame keyed by id. Its columns are written as a table of
their own and joined back, so a failed stage leaves its columns unknown (NULL), never
empty, and a later run computes only what is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Stage:
    name: str
    schema: str  # of the added columns
    make: Callable[[DataFrame], DataFrame]  # (id, added columns)


def build(spark: SparkSession, trails: DataFrame, stages: list[Stage], path: str, skip: set[str] = frozenset(), resume: bool = False) -> tuple[DataFrame, DataFrame]:
    """(trails with all stages' columns, manifest (ord, stage, status, detail)); both are also written."""
    done, manifest = trails, []
    for n, stage in enumerate(stages):
        table, added = f"{path}/stages/{stage.name}", None
        status, detail = "skipped", None
        if stage.name not in skip:
            try:
                if resume:
                    try:
                        added, status = spark.read.parquet(table), "resumed"
                    except AnalysisException as missing:  # nothing stored yet; any other error is the stage's
                        if "PATH_NOT_FOUND" not in str(missing):
                            raise
                        detail = type(missing).__name__
                if added is None:
                    stage.make(done).write.mode("overwrite").parquet(table)
                    added, status, detail = spark.read.parquet(table), "ok", None
            except Exception as failure:  # noqa: BLE001  one stage must not stop the others
                added, status, detail = None, "failed", str(failure)[:300]
        if added is None:
            kind = dict(trails.dtypes)["id"]
            added = spark.createDataFrame([], f"id {kind}, {stage.schema}")
        done = done.join(added, "id", "left")
        manifest.append((n, stage.name, status, detail))
    table = spark.createDataFrame(manifest, "ord int, stage string, status string, detail string").withColumn("rows", F.lit(None).cast("long"))
    table.write.mode("overwrite").parquet(f"{path}/manifest")
    done.write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index"), table
