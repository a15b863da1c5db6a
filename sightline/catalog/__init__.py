"""Registered queries: each with the Spark function and, where SQL can state it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "audit", "scores", "mining", "citing", "joins", "metrics", "series", "business", "paging", "crawling", "jobs", "sinks",
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with SQL that must give the same rows."""
    from sightline.session import ensure_conf, ship_package
    from sightline.sources.derived import TestTables

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")

        def run(spark: SparkSession, path: str) -> DataFrame:
            ensure_conf(spark)
            ship_package(spark)
            return fn(TestTables(spark, path))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def load() -> None:
    for module in MODULES:
        import_module(f"sightline.catalog.{module}")
