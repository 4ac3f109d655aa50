"""Named queries with, where SQL can express them, the SQL to check them."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from paneltide.plans.sqltext import compose

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, deps: str | None = None, sql: str | None = None):
    """Register a query; ``deps`` names the SQL parts that ``sql`` uses."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = compose(deps or "", sql)
        return fn

    return add
