"""Where queries and their SQL twins are entered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Enters a query by name, with SQL for DuckDB if there is any."""

    def enter(f):
        if name in QUERIES:
            raise ValueError(f"{name} is entered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return enter


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six places, as both engines compare values."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)
