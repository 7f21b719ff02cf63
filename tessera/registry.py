"""All queries of the library by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: adds a query, and its SQL if it has one."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def _loaded() -> None:
    """Imports the modules whose queries register themselves."""
    from tessera import plans

    plans.load()


def queries() -> dict[str, Query]:
    _loaded()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(_SQL)
