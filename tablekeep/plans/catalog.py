"""Registry of named queries: a Spark plan and, where SQL can say it, an independent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablekeep.plans.fixtures import Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name`` with its checking SQL."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if check is not None:
            CHECKS[name] = with_views(check.strip(), "duckdb")
        return fn

    return register
