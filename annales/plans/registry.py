"""All queries of the core and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annales.plans import queries_build, queries_graph, queries_search, queries_text

FLAGSHIP = "hybrid_search"
_MODULES = (queries_build, queries_graph, queries_search, queries_text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, (f, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
