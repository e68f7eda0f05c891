"""Registered queries of the training-data operators, and SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from civicspark.llm import bpe, decontaminate, langid, licenses, media, mixing, near_dedup, pii, quality, repair, suffix_dedup, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_media_columns": media.op3_media_columns,
    "op4_quality": quality.op4_quality,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_pii": pii.op7_pii,
    "op8_licenses": licenses.op8_licenses,
    "op9_mixing": mixing.op9_mixing,
    "op10_language": langid.op10_language,
    "op11_bpe": bpe.op11_bpe,
    "op12_repair": repair.op12_repair,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL: dict[str, str] = {"op8_licenses": licenses.licences_sql(), "op9_mixing": mixing.mixing_sql()}
