"""Registered queries, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with the SQL of its result where SQL can say it."""

    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    """Import the modules that register queries."""
    from millrace.plans import accounting, evaluation, files, pools, projections, rows, sampling, selection, streams  # noqa: F401


load()
