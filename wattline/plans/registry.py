"""Registry of named queries and their check queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattline.plans.oracle import full_sql
from wattline.session import pin
from wattline.sources.derived import GridTables

QUERIES: dict[str, Callable[[GridTables], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def register(name: str, check: str | None = None):
    """Decorator: add a query over the derived tables, with its DuckDB text where one exists."""

    def add(fn: Callable[[GridTables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = full_sql(check)
        return fn

    return add


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return QUERIES[name](GridTables(pin(spark), folder))

    run.__name__ = name
    return run
