"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every id that has a link to another; links: u long, v long.

    Direction, repeats and self-links make no difference. Each round is written to the shared folder, so a lost executor
    repeats one round only; only a count and a checksum reach the driver. Links whose u or v is null are dropped: they name
    no partner. A component's star is summed up before it is shuffled, and large stars are joined as skewed keys.
    """
    edges = common.cut(spark, links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.cut(spark, large, "large")
        before = edges
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.cut(spark, small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        common.free(spark, before, large)
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select("v", F.col("v").alias("w")).distinct().toDF("id", "component"))


def named(members: DataFrame, names: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """``members`` with their group's row of ``names`` (one for each ``key``): a large group is dealt out over ``salts`` tasks."""
    dealt = members.withColumn("__salt", F.pmod(F.xxhash64(*members.columns), F.lit(salts)).cast("int"))
    every = names.withColumn("__salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
    return dealt.join(every, [key, "__salt"]).drop("__salt")
