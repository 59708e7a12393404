"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module that has it.
MODULES = {
    "op1_line_dedup": "line_dedup",
    "op2_substring_dedup": "substring_dedup",
    "op3_url_filter": "url_filter",
    "op4_exact_dedup": "exact_dedup",
    "op5_sentencepiece": "sentencepiece_codec",
    "op6_source_mixing": "mixing",
    "op7_winnowing": "winnowing",
    "op8_near_dedup": "near_dedup",
    "op9_quality": "quality",
    "op10_token_store": "token_store",
    "op11_hard_negatives": "hard_negatives",
    "op12_simhash": "simhash",
    "op13_lexical_search": "lexical_search",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}
    return found | {"pipeline": import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    found["pipeline"] = import_module("corpus_pipeline").ORACLE_SQL
    return {name: sql for name, sql in found.items() if sql}
