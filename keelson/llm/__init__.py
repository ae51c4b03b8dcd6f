"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

A query's module is imported when it is called: Python workers import this package with any operator's functions, and would hold the
libraries of all of them."""

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_chat_formatting": "chat",
    "op2_document_fingerprints": "fingerprints",
    "op3_quality_classifier": "quality",
    "op4_suffix_array_dedup": "substrings",
    "op5_simhash_near_dedup": "simhash",
    "op6_html_extraction": "wrappers",
    "op7_nearest_neighbours": "neighbours",
    "op8_mixing_sources": "mixing",
    "op9_personal_data": "personal",
    "op10_byte_level_bpe": "bpe",
    "op11_best_fit_packing": "packing",
    "op12_ranked_search": "ranking",
    "op13_hard_negatives": "negatives",
}


def _query(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: import_module(f"keelson.llm.{module}").query(spark, sf_dir)


QUERIES = {name: _query(module) for name, module in _MODULES.items()}


def __getattr__(name: str) -> dict[str, str]:
    """ORACLES, read from the modules when asked for."""
    if name != "ORACLES":
        raise AttributeError(name)
    with_sql = ("op1_chat_formatting", "op8_mixing_sources", "op12_ranked_search", "op13_hard_negatives")
    return {query: import_module(f"keelson.llm.{_MODULES[query]}").ORACLE_SQL for query in with_sql}
