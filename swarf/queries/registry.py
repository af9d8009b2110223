"""Registry that keeps each runnable query next to its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of ``Tables`` under its own name, with the SQL that must give equal rows."""

    def wrap(fn):
        from swarf.sources.tables import Tables

        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        MODULES[fn.__name__] = fn.__module__.rsplit('.', 1)[-1]
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def r(expr: str, digits: int = 6, name: str | None = None) -> str:
    """SQL rounding that never yields a negative zero."""
    text = f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"
    return f"{text} AS {name}" if name else text
