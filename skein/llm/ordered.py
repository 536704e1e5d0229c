"""Running sums over ordered groups of any size: a group is dealt out by ranges, never gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def place(spark: SparkSession, df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` by ranges of (group, order), written to the shared folder with the range's number as ``part``.

    Rows that are equal in all of these columns stay in one range, so ``order`` should end in something that tells rows apart.
    """
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return common.cut(spark, df.repartitionByRange(ranges, *group, *order).withColumn("part", F.spark_partition_id()), name)


def running(placed: DataFrame, group: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """``placed`` with the sum of ``value`` over its group up to each row as ``name``; no column of ``group`` may be null.

    Sums run within a range; what the ranges before hold of a group is one row for each range that the group reaches into, so
    that the widest window is over as many rows as there are ranges.
    """
    parts = placed.groupBy(*group, "part").agg(F.sum(value).alias("held"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.sum("held").over(before)).where(F.col("start").isNotNull()).drop("held")
    within = Window.partitionBy(*group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumn(name, F.sum(value).over(within)).join(starts.hint("merge"), [*group, "part"], "left")
    return out.withColumn(name, F.col(name) + F.coalesce("start", F.lit(0))).drop("start")
