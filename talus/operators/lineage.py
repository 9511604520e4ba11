"""Cutting the lineage of iterative jobs through the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the folder that spark.checkpoint.dir names.

    Without one, or a folder the caller has set, this is an error on a cluster: a folder of
    one machine would lose what the others wrote. A local master has one machine only.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/talus-checkpoints")
    return df.checkpoint()
