"""Operators for training-data pipelines. Nothing outside this package imports it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, decontamination, langid, packing, pages, passages, pii, quality, ranking, sharding, simhash, suffix, warc

_QUERIES = {
    "op1_best_fit_packing": packing,
    "op2_sharding": sharding,
    "op3_decontamination": decontamination,
    "op4_pii_pseudonyms": pii,
    "op5_warc_archives": warc,
    "op6_suffix_dedup": suffix,
    "op7_language_id": langid,
    "op8_quality_rules": quality,
    "op9_passage_dedup": passages,
    "op10_simhash_near_dedup": simhash,
    "op11_html_extraction": pages,
    "op12_ranked_search": ranking,
    "op13_vector_codes": codes,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _QUERIES.items() if getattr(module, "ORACLE_SQL", None)}
