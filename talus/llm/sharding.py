"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

``sharded`` maps a stable key to a shard with no ring table: the key and the number of
shards decide alone, and with one more shard a row either stays or moves to the new one.

Defined results: a null key hashes as if it were -1; a null text has no bytes; repeated rows get slots of their own; an empty table gives an empty
result; columns of the input other than the key and the text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, numbered, stored, table

SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key: jumps forward until the next jump leaves the range."""
    state = mixed(keys.astype(np.int64).view(np.uint64))
    at, to = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.float64)
    going = np.arange(len(keys))
    while len(going):
        at[going] = to[going].astype(np.int64)
        state[going] = state[going] * np.uint64(2862933555777941757) + np.uint64(1)
        to[going] = np.floor((at[going] + 1) * (2.0**31 / ((state[going] >> np.uint64(33)).astype(np.float64) + 1)))
        going = going[to[going] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(), shards).astype(np.int32))

    return shard(F.coalesce(key.cast("long"), F.lit(-1)))


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot) for each row of docs.

    Only the narrow row leaves the scan; slots are numbered bucket by bucket, so the
    numbering of a shard is spread over many tasks.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"))
    narrow = stored(narrow.withColumn("shard", shard_of(F.col(key), shards)).withColumn("grown_shard", shard_of(F.col(key), shards + 1)))
    return numbered(narrow, "shard", [key, "size", "text_crc32"], "slot", narrow.count())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
