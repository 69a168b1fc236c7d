"""The registered queries of the reference operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Modules that register queries when imported.
_MODULES = ("analytics", "scalars", "tokens", "search", "merge", "segments", "state", "training", "streams", "files", "corrections", "labels", "lookups", "recovery", "drivers")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the function under its name, with its SQL twin if it has one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in _MODULES:
        import_module(f"quire.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
