"""Degrees, counts and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CONTAINS, Graph
from .tables import cut


def degrees(g: Graph, relationships_out: tuple[str, ...] = ()) -> DataFrame:
    """id, in_degree, out_degree of every node (0 if isolated), not counting edges of the given relationships.

    One shuffle of the edges: each is unfolded to its two ends and summed on both sides at once. Edges that are cut are read twice
    instead, which is less work.
    """
    edges = g.dealt("src", "dst")
    edges = edges.where(~F.col("relationship").isin(*relationships_out)) if relationships_out else edges
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    if getattr(g.edges, "cut_folder", None):
        end = lambda c, i: edges.select(F.col(c).alias("id"), F.lit(i).alias("i"), F.lit(1 - i).alias("o"))
        ends = end("dst", 1).unionByName(end("src", 0))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return g.nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def most(d: DataFrame) -> tuple[int, int]:
    """The largest in- and out-degree; two numbers."""
    r = d.agg(F.max("in_degree"), F.max("out_degree")).first()
    return int(r[0] or 0), int(r[1] or 0)


def normalised(g: Graph, relationships_out: tuple[str, ...] = (), least: int = 0) -> DataFrame:
    """Degrees with norm_in and norm_out, over the largest or ``least``; 0 where that is 0."""
    d = degrees(g, relationships_out)
    d = cut(d) if getattr(g.edges, "cut_folder", None) else d
    top = d.agg(F.greatest(F.max("in_degree"), F.lit(least)).alias("max_in"), F.greatest(F.max("out_degree"), F.lit(least)).alias("max_out"))
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.join(F.broadcast(top)).select("id", "in_degree", "out_degree", over("in_degree", "max_in").alias("norm_in"), over("out_degree", "max_out").alias("norm_out"))


def migration_degrees(g: Graph) -> DataFrame:
    return normalised(g, (CONTAINS,), least=1)


def total_degree(g: Graph) -> DataFrame:
    return degrees(g).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))


def degree_json(g: Graph) -> DataFrame:
    """id and JSON of in, out and total for nodes of kind File."""
    d = degrees(g).join(g.nodes.where("kind = 'File'").select("id"), "id", "left_semi")
    return d.select("id", F.to_json(F.struct(F.col("in_degree").alias("in"), F.col("out_degree").alias("out"), (F.col("in_degree") + F.col("out_degree")).alias("total"))).alias("artifact"))


def kind_counts(g: Graph) -> DataFrame:
    return g.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def graph_counts(g: Graph) -> DataFrame:
    n, e = g.nodes.agg(F.count(F.lit(1)).alias("node_count")), g.edges.agg(F.count(F.lit(1)).alias("edge_count"))
    return n.join(F.broadcast(e))


def leaves(g: Graph) -> DataFrame:
    """Nodes without an edge out."""
    return g.nodes.join(g.edges.select(F.col("src").alias("id")), "id", "left_anti")


def roots(g: Graph) -> DataFrame:
    """Nodes without an edge in."""
    return g.nodes.join(g.edges.select(F.col("dst").alias("id")), "id", "left_anti")


def orphans(g: Graph) -> DataFrame:
    return leaves(Graph(roots(g), g.edges))


def hubs(g: Graph, n: int) -> DataFrame:
    """The n nodes of the largest total degree."""
    return total_degree(g).orderBy(F.desc("degree"), "id").limit(n)


def degree_flags(g: Graph, hub: float = 0.5) -> DataFrame:
    d = normalised(g)
    return d.select("id", ((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("is_isolated"), (F.col("in_degree") == 0).alias("is_leaf"), (F.col("norm_in") >= hub).alias("is_hub"))


def affected_roots(paths: DataFrame, pattern: str = r"crates/([^/]+)") -> DataFrame:
    """id and the number of distinct crates among its dependents' paths, 1 at least; paths: id, path."""
    return paths.groupBy("id").agg(F.greatest(F.lit(1), F.count_distinct(F.nullif(F.regexp_extract("path", pattern, 1), F.lit("")))).alias("affected"))


def in_degrees(edges: DataFrame) -> DataFrame:
    """id and in_degree of every node that an edge goes to."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def edge_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("n"))
