"""A property graph as two DataFrames.

nodes: id, pos, name, kind, path and optionally relative_path, extension, language, has_tests, metadata.
edges: src, dst, relationship, pos. ``pos`` is the original list place, which decides "first" among equals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTAINS = "contains"
#: Edges that a task sums or sorts at once, about.
PART = 1_000_000
#: Relationships that are numbered, at most.
KINDS = 64


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    #: About how many edges there may be, where that is cheap to know: it decides over how many tasks they are dealt, nothing else.
    about: Callable[[], int] | None = None

    def parts(self) -> int:
        """Parts of about PART edges; 0 where that isn't known or no more than there are cores."""
        n = -(-self.about() // PART) if self.about else 0
        return n if n > self.edges.sparkSession.sparkContext.defaultParallelism else 0

    def dealt(self, *by: str) -> DataFrame:
        """The edges in that many parts, by columns; as they are where there are few."""
        n = self.parts()
        return self.edges.repartition(n, *by) if n else self.edges

    def cut(self) -> "Graph":
        """The same graph, its tables written once for all that follows."""
        from .operators.tables import cut

        return replace(self, nodes=cut(self.nodes), edges=cut(self.edges))

    def where(self, condition: Column) -> "Graph":
        """Nodes that meet a condition and the edges among them."""
        return Graph(self.nodes.where(condition), self.edges).clean()

    def clean(self) -> "Graph":
        """Edges whose two ends exist."""
        ids = self.nodes.select("id")
        inside = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return replace(self, edges=inside.select(*self.edges.columns))

    def add_edges(self, more: DataFrame) -> "Graph":
        """Appends edges; those that name a missing node or loop are left out."""
        return replace(self, edges=self.edges.unionByName(Graph(self.nodes, more.where("src <> dst")).clean().edges))

    def with_metadata(self, values: DataFrame, key: str) -> "Graph":
        """Upserts ``key`` into the metadata of the nodes in ``values`` (id, value)."""
        entry = F.create_map(F.lit(key), F.col("value").cast("string"))
        have = F.coalesce("metadata", F.expr("map()").cast("map<string,string>"))
        joined = self.nodes.join(values.select("id", "value"), "id", "left")
        merged = F.when(F.col("value").isNull(), have).otherwise(F.map_concat(F.map_filter(have, lambda k, v: k != key), entry))
        return replace(self, nodes=joined.withColumn("metadata", merged).select(*self.nodes.columns))

    def both_ways(self) -> DataFrame:
        """id, peer, relationship, pos: each edge seen from both ends, a loop once."""
        forth = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("peer"), "relationship", "pos")
        back = self.edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("peer"), "relationship", "pos")
        return forth.unionByName(back)

    def pairs(self) -> DataFrame:
        """a, b, relationship: the pairs of nodes that edges of either direction join, a <= b, with the relationship of the first edge between the two."""
        ends = self.edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relationship", "pos")
        general = F.min_by("relationship", F.struct("pos", "relationship")).alias("relationship")
        if not getattr(self.edges, "cut_folder", None):
            return ends.groupBy("a", "b").agg(general)
        kinds = self.edges.groupBy("relationship").agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.count_if(F.col("pos").isNull()).alias("none")).limit(KINDS + 1).collect()
        names = sorted(k.relationship for k in kinds if k.relationship is not None)
        if not names or len(names) < len(kinds) or len(kinds) > KINDS or any(k.none or max(-k.low, k.high) >= 1 << 52 for k in kinds):
            return ends.groupBy("a", "b").agg(general)
        # Place and relationship as one number, so that sums go by hash, which they don't for strings; sorted names keep ties as they are.
        number = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))]) if len(names) > 1 else None
        first = F.min(F.col("pos").cast("long") * KINDS + (number[F.col("relationship")] if len(names) > 1 else F.lit(0)))
        return ends.groupBy("a", "b").agg(first.alias("first")).select("a", "b", F.array(*map(F.lit, names))[F.pmod("first", F.lit(KINDS)).cast("int")].alias("relationship"))

    def adjacency(self, pairs: DataFrame | None = None) -> DataFrame:
        """id, peer, relationship: distinct neighbours with the relationship of the first edge between the two. ``pairs`` if they
        are made already: each is summed once and then seen from both ends."""
        pairs = self.pairs() if pairs is None else pairs
        forth = F.struct(F.col("a").alias("id"), F.col("b").alias("peer"))
        back = F.struct(F.col("b").alias("id"), F.col("a").alias("peer"))
        ends = F.when(F.col("a") == F.col("b"), F.array(forth)).otherwise(F.array(forth, back))
        return pairs.select(F.explode(ends).alias("e"), "relationship").select("e.id", "e.peer", "relationship")

    def transform(self, step: Callable[["Graph"], "Graph"]) -> "Graph":
        return step(self)
