"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = {
    "op1_ngram_jaccard_join": "ngram_jaccard",
    "op2_language_id": "language_id",
    "op3_pivot_topk": "pivot_topk",
    "op4_token_files": "token_files",
    "op5_secret_scan": "secret_scan",
    "op6_url_filter": "url_filter",
    "op7_license_scan": "license_scan",
    "op7_license_passages": "license_passages",
    "op8_bpe_stream": "bpe_stream",
    "op9_decontaminate": "decontaminate",
    "op10_quality_mil": "quality_mil",
    "op11_piecewise_hash": "piecewise_hash",
    "op12_source_divergence": "source_divergence",
    "op13_periodic_runs": "periodic_runs",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"attrita.llm.{m}").query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"attrita.llm.{m}"), "ORACLE_SQL", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
