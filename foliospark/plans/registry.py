"""Every registered query of the engine with its SQL, gathered from the modules of foliospark.plans."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "TXT8"
MODULES: tuple[str, ...] = ("relational", "sequences", "texts", "entities", "listings")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds the decorated function as query key; sql is what DuckDB runs on the same tables, if it can."""

    def add(query: Query) -> Query:
        if key in _QUERIES:
            raise ValueError(f"{key} is registered twice")
        _QUERIES[key] = query
        if sql:
            _SQL[key] = sql
        return query

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"foliospark.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
