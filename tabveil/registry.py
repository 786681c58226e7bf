"""Named queries over the tables of a folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "a16_suppressed_counts"

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


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    from tabveil import plans

    plans.load()
    return _queries


def oracle_sql() -> dict[str, str]:
    queries()
    return _oracles
