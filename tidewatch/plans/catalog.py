"""Registry of queries: a name, the Spark plan, and SQL that checks its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.plans.adapters import Tables, oracle_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``plan(tables) -> DataFrame`` under ``name``."""

    def register(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle_text(sql)
        return plan

    return register
