"""Every query of the engine by name, bound to the driver tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} is there already")
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _loaded() -> None:
    from . import catalog_events, catalog_nulls, catalog_pointed, catalog_robust, catalog_words  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _loaded()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_SQL)
