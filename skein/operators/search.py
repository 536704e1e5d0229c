"""Looking nodes up: selectors, text search and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph


class Selector:
    """A condition on nodes."""

    def __init__(self, condition: Column):
        self.condition = condition

    @classmethod
    def all(cls) -> "Selector":
        return cls(F.lit(True))

    @classmethod
    def by_kind(cls, kind: str) -> "Selector":
        return cls(F.col("kind") == kind)

    @classmethod
    def explicit(cls, ids: list[int]) -> "Selector":
        return cls(F.col("id").isin(ids))

    @classmethod
    def has_metadata(cls, key: str) -> "Selector":
        return cls(F.coalesce(F.map_contains_key("metadata", key), F.lit(False)))

    @classmethod
    def predicate(cls, condition: Column) -> "Selector":
        return cls(condition)

    def matches(self, nodes: DataFrame) -> DataFrame:
        return nodes.where(self.condition)


def _held(text: str, *columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return out


def _limited(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows by pos, each with the number of all; the count is one number, not a window over all rows."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("pos").limit(limit).join(F.broadcast(total))


def search_nodes(nodes: DataFrame, query: str, kind: str | None = None, extension: str | None = None, limit: int = 20) -> DataFrame:
    """Nodes whose name or path holds ``query``, in any case; the first ``limit`` by pos and the total of matches."""
    found = nodes.where(_held(query, *[c for c in ("name", "path", "relative_path") if c in nodes.columns]))
    if kind:
        found = found.where(F.lower("kind") == kind.lower())
    if extension:
        found = found.where(extension_of("path") == extension)
    return _limited(found, limit)


def list_files(nodes: DataFrame, path: str = "", extension: str | None = None, kind: str | None = None, limit: int = 20) -> DataFrame:
    found = nodes.where("kind <> 'Directory'")
    if path:
        at = F.contains("path", F.lit(path))
        found = found.where(at | F.col("relative_path").startswith(path) if "relative_path" in nodes.columns else at)
    if extension:
        found = found.where(extension_of("path") == extension)
    if kind:
        found = found.where(F.lower("kind") == kind.lower())
    return _limited(found, limit)


def extension_of(path: str) -> Column:
    """After the last dot of the file name; empty for none or a leading dot alone."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def find_by_path(nodes: DataFrame, path: str) -> DataFrame:
    """One row at most: the first node whose path is equal, else whose relative path is, else whose path ends so, in any case."""
    relative = F.col("relative_path") if "relative_path" in nodes.columns else F.lit(None).cast("string")
    rank = F.when(F.col("path") == path, 1).when(relative == path, 2).when(F.endswith(F.lower("path"), F.lit(path.lower())), 3)
    return nodes.withColumn("rank", rank).where("rank is not null").orderBy("rank", "pos").limit(1)


def find_by_text(nodes: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Scores: the name itself 1, its beginning .9, within it .7, within the path .5."""
    q, name = query.lower(), F.lower("name")
    score = F.when(name == q, 1.0).when(name.startswith(q), 0.9).when(F.contains(name, F.lit(q)), 0.7).when(_held(q, "path"), 0.5)
    return nodes.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "id").limit(limit)


def run_search(nodes: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """Queries of under two characters find nothing."""
    return find_by_text(nodes, query, limit if len(query) >= 2 else 0)


def find_relationship(g: Graph, a: int, b: int) -> DataFrame:
    """The first edge's relationship between two nodes in either direction, else unknown."""
    between = g.edges.where(((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a)))
    return between.agg(F.coalesce(F.min_by("relationship", F.struct("pos", "relationship")), F.lit("unknown")).alias("relationship"))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule; fewer than three corners hold nothing."""
    if len(corners) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, corners[-1:] + corners[:-1]):
        if ay != by:
            crossings = crossings + F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    return crossings % 2 == 1


def lasso(g: Graph, positions: DataFrame, corners: list[tuple[float, float]]) -> Graph:
    """Nodes whose position (id, x, y) lies in the polygon and the edges that touch one."""
    inside = positions.where(in_polygon(F.col("x"), F.col("y"), corners)).select("id")
    ends = inside.withColumnRenamed("id", "peer")
    touching = g.edges.join(ends.withColumnRenamed("peer", "src"), "src", "left_semi").unionByName(g.edges.join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ends.withColumnRenamed("peer", "src"), "src", "left_anti").select(*g.edges.columns))
    return Graph(g.nodes.join(inside, "id", "left_semi"), touching.select(*g.edges.columns))


def first_by_path(nodes: DataFrame) -> DataFrame:
    """The first node of each path."""
    order = Window.partitionBy("path").orderBy("pos")
    return nodes.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def first_by_name(nodes: DataFrame) -> DataFrame:
    """The first node of each name, directories left out."""
    order = Window.partitionBy("name").orderBy("pos")
    return nodes.where("kind <> 'Directory'").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def node_path(nodes: DataFrame) -> Column:
    """The path, else the relative path."""
    have = [F.col(c) for c in ("path", "relative_path") if c in nodes.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def node_info(nodes: DataFrame) -> DataFrame:
    """id, name, kind in lower case and path, or the name where there is none."""
    return nodes.select("id", "name", kind_string(F.col("kind")).alias("kind"), F.coalesce(node_path(nodes), "name").alias("path"))


def kind_string(kind: Column) -> Column:
    return F.lower(kind)


def is_container(kind: Column) -> Column:
    return kind.isin("Directory", "Module")


def get_node(nodes: DataFrame, id: int) -> DataFrame:
    """The node of an id, the first by pos; one row at most."""
    return nodes.where(F.col("id") == id).orderBy("pos").limit(1)


def node_id(nodes: DataFrame, path: str) -> DataFrame:
    """id of the first node at exactly this path; one row at most."""
    return nodes.where(F.col("path") == path).orderBy("pos").limit(1).select("id")


def all_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("id")
