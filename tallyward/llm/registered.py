"""Registration of the corpus queries and their SQL counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

# Each module offers QUERY = (name, function) and may offer ORACLE_SQL.
_MODULES = (
    "bytes_query",
    "mixing_query",
    "secrets_query",
    "near_query",
    "search_query",
    "leaks_query",
    "tokens_query",
    "language_query",
    "repeats_query",
    "warc_query",
    "spelling_query",
    "negatives_query",
    "toxicity_query",
)


def _loaded() -> list:
    return [importlib.import_module(f"tallyward.llm.{module}") for module in _MODULES]


def queries() -> dict[str, Query]:
    return dict(module.QUERY for module in _loaded())


def oracle_sql() -> dict[str, str]:
    return {m.QUERY[0]: m.ORACLE_SQL.strip() for m in _loaded() if getattr(m, "ORACLE_SQL", None)}
