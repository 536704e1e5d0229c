"""All queries of the graph engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import extras, finer, iterative, relational, surface, textual  # noqa: F401  enter their queries
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the twenty most urgent items of work in the graph of the tables."""
    return QUERIES["k10_structural_plan"](spark, sf_dir)
