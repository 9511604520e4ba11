"""Corpus pipeline: STAGES applied in turn to documents, each stage written and read again.

Language identification drops texts without a language, SimHash near-dedup keeps one
document of each group, decontamination drops documents that hold a benchmark item, PII
puts pseudonyms in the texts, and best-fit packing returns the pieces of the kept texts
with their sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm import decontamination, langid, neardup, packing, pii
from talus.llm.common import shipped, stored, table, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return langid.accepted(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymised(docs, pii.session_key(spark), count=unused(docs, "_replaced"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return packing.packed(docs)


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("decontamination", decontaminate), ("pii", pseudonyms), ("packing", pack)]

#: Tokenizing and greedy tiling have no SQL form; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
