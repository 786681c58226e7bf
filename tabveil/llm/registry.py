"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return add


def load() -> None:
    from tabveil.llm import llm_queries  # noqa: F401


def queries() -> dict[str, Query]:
    load()
    return _queries


def oracle_sql() -> dict[str, str]:
    load()
    return _oracles
