"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with a QUERY (name, callable) and an ORACLE (SQL text or None).
MODULES = (
    "packing",
    "warc",
    "topk_search",
    "language_id",
    "byte_bpe",
    "url_filter",
    "line_dedup",
    "toxicity",
    "exact_dedup",
    "simhash_dedup",
)


def _modules():
    return [import_module(f"gridloom.llm.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable of (spark, sf_dir)."""
    return {m.QUERY[0]: m.QUERY[1] for m in _modules()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL, for the queries that SQL can express."""
    return {m.QUERY[0]: m.ORACLE for m in _modules() if m.ORACLE}
