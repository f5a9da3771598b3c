"""Collects the queries of all operator modules, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}
#: Operator modules that register queries when imported.
MODULES: tuple[str, ...] = tuple(f"mediaquarry.plans.{m}" for m in ("listing", "vectors", "search", "store", "scalars", "fusion", "events", "frames", "selection", "planning", "records", "review", "album", "verify"))


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) as a query, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLE[name] = sql
        return f

    return add


def _load() -> None:
    import importlib

    for name in MODULES:
        importlib.import_module(name)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
