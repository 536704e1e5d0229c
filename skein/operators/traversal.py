"""Bounded traversal, selections over it, PageRank, and graphs made from graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import CONTAINS, Graph
from .degrees import in_degrees
from .tables import cut, free, in_buckets, laid_out, summed


def layers(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id and the least number of steps (0 for seeds) along edges (src, dst), at most ``depth``; ends early when nothing is new.

    Hops run as a driver loop of semi-joins: a recursive query would carry every path to a node, this carries each node once.
    """
    seen = frontier = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier, found = summed(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)), F.count(F.lit(1)).alias("n"))
        if not found.n:
            free(frontier)
            break
        seen = seen.unionByName(frontier)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def impact(g: Graph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes that depend on the seeds within ``depth`` steps, containment left out: the node, depth and in_degree, most depended on first."""
    edges = g.edges.where(F.col("relationship") != CONTAINS)
    found = layers(reverse(edges), seeds, depth).where("depth > 0")
    # Only edges to what was found are counted, not the degrees of all nodes.
    rank = in_degrees(edges.join(found.select(F.col("id").alias("dst")), "dst", "left_semi"))
    nodes = g.nodes.join(found.select("id"), "id", "left_semi").join(found, "id").join(rank, "id", "left")
    return nodes.withColumn("in_degree", F.coalesce("in_degree", F.lit(0).cast("long"))).orderBy(F.desc("in_degree"), "pos")


def context(g: Graph, node_id: int, depth: int = 1) -> Graph:
    """The nodes within ``depth`` steps in either direction and the edges among them."""
    both = g.both_ways().select(F.col("id").alias("src"), F.col("peer").alias("dst"))
    near = layers(both, g.nodes.where(F.col("id") == node_id), depth)
    return Graph(g.nodes.join(near, "id"), g.edges).clean()


def expand(g: Graph, base: DataFrame, depth: int, mode: str = "union") -> DataFrame:
    """Ids of a selection grown by signed depth: above 0 towards parents, below 0 towards children.

    union (and accumulate): all up to that depth; replace: those at just that depth.
    """
    found = layers(reverse(g.edges) if depth > 0 else g.edges, base, abs(depth))
    return (found.where(F.col("depth") == abs(depth)) if mode == "replace" else found).select("id")


def invert(nodes: DataFrame, selection: DataFrame) -> DataFrame:
    return nodes.select("id").join(selection.select("id"), "id", "left_anti")


#: A node's share of what one node gave is not passed on below this: over all rounds that is less than 1e-10 of a node's rank.
LEAST_GIVEN = 1e-12


def pagerank(g: Graph, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """id, rank: textbook PageRank; parallel edges count each, the rank of nodes without an edge out goes to all alike.

    With A for one round along the edges and 1 for one unit at each node, the ranks after any round are a sum of c_j A^j 1: what
    dead ends give back to all alike only changes the numbers c_j, and these follow from the mass that A^j 1 has at dead ends.
    So one unit is pushed along the edges, only nodes that still get some are in the next round, and a graph without cycles is
    done after its longest path. A round is a join with the shares, which lie by their source if they are large, and one sum, its
    partial sums made before the shuffle, so that a node that many link to is no hot key. Two sums a round reach the driver.
    """
    n = g.nodes.count()
    # Both sums over the edges, and the join of the two, are of one dealing.
    edges, parts = g.dealt("src"), g.parts()
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    inside = g.nodes.select(F.col("id").alias("dst"), F.lit(True).alias("inside"))
    shares = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c")).join(out, "src")
    shares = (shares.repartition(parts, "dst") if parts else shares).join(inside, "dst", "left")
    shares = laid_out(shares.select("src", "dst", (F.col("c") / F.col("n")).alias("share"), F.coalesce("inside", F.lit(False)).alias("inside")), "src")
    by = "id" if in_buckets(shares) else None
    total, inner = F.coalesce(F.sum("given"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.when(F.col("inside"), F.col("given"))), F.lit(0.0)).alias("inner")
    given, held, ended = [cut(g.nodes.select("id", F.lit(1.0).alias("given"), F.lit(True).alias("inside")), by)], float(n), []
    for _ in range(rounds):
        step = given[-1].where(F.col("inside") & (F.col("given") >= LEAST_GIVEN)).join(shares, F.col("id") == F.col("src"))
        step = step.groupBy(F.col("dst").alias("id")).agg((damping * F.sum(F.col("given") * F.col("share"))).alias("given"), F.bool_or(shares["inside"]).alias("inside"))
        table, sums = summed(step, total, inner, F.count(F.lit(1)).alias("n"), by=by)
        # What did not go on was at dead ends.
        ended.append(max(0.0, held - sums.total / damping))
        held = sums.inner
        if not sums.n:
            free(table)
            break
        given.append(table)
    weights = [1.0 / max(1, n)]
    for _ in range(rounds):
        weights = [(1 - damping) / max(1, n) + damping / max(1, n) * sum(c * m for c, m in zip(weights, ended)), *weights]
    parts = [t.where("inside").select("id", (F.col("given") * c).alias("rank")) for t, c in zip(given, weights)]
    rank = cut(reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("rank").alias("rank")))
    free(shares, *given)
    return rank


#: The prime that generated numbers are taken modulo.
MODULUS = 2_147_483_647


def mixed(x: Column, seed: int) -> Column:
    """A number from 0 to below MODULUS that looks drawn, from a number's lowest 31 bits: whole-number arithmetic that any engine can do."""
    m = F.lit(MODULUS)
    u = F.pmod((F.pmod(x, m) + (seed + 1)) * 48271, m)
    u = F.pmod(u * (F.pmod(u, F.lit(9973)) + 1) + F.pmod(x, m), m)
    u = F.pmod(u * 69621, m)
    return F.pmod(u * (F.pmod(u, F.lit(7919)) + 1) + seed, m)


def random_graph(spark: SparkSession, n: int, seed: int = 42) -> Graph:
    """n nodes and 3n random edges without loops."""
    nodes = spark.range(n).select("id", F.col("id").alias("pos"), F.concat(F.lit("node_"), "id").alias("name"), F.lit("File").alias("kind"), F.concat(F.lit("node_"), "id").alias("path"))
    pick = spark.range(3 * n).select(F.col("id").alias("pos"), F.pmod(mixed(F.col("id"), seed), F.lit(max(1, n))).alias("src"), F.pmod(mixed(F.col("id"), seed + 1), F.lit(max(1, n - 1))).alias("skip"))
    edges = pick.select("src", F.when(F.col("skip") >= F.col("src"), F.col("skip") + 1).otherwise(F.col("skip")).alias("dst"), F.lit("uses").alias("relationship"), "pos")
    return Graph(nodes, edges if n > 1 else edges.limit(0))


#: References that a draw follows at most; each ends it with a chance of one half.
HOPS = 48


def scale_free_graph(spark: SparkSession, n: int, m: int, seed: int = 42) -> Graph:
    """Preferential attachment: node k links to m earlier nodes, drawn by their degree.

    Drawing an end of a random earlier edge is drawing by degree, so the targets follow from the edge numbers alone: a
    reference to edge j's target is followed until it names a node. No driver loop over nodes.
    """
    nodes = random_graph(spark, n, seed).nodes
    e = spark.range(max(0, n - 1) * m).select(F.col("id").alias("pos"), (F.floor(F.col("id") / m) + 1).cast("long").alias("src"))

    def step(a, depth):
        """Half of the draws name the source of an earlier edge, half go on to that edge's own target."""
        pos = a["pos"]
        own = (F.floor(pos / m) + 1).cast("long")
        h = F.pmod(mixed(pos, seed), 2 * F.greatest(pos, F.lit(1).cast("long")))
        at = F.floor(h / 2).cast("long")
        source = F.least((F.floor(at / m) + 1).cast("long"), own - 1)
        found = F.when(pos == 0, F.lit(0).cast("long")).when((h % 2 == 0) | (depth == HOPS - 1), source)
        return F.struct(F.when(a["dst"].isNull(), at).otherwise(pos).alias("pos"), F.coalesce(a["dst"], found).alias("dst"))

    start = F.struct(F.col("pos").alias("pos"), F.lit(None).cast("long").alias("dst"))
    target = F.aggregate(F.sequence(F.lit(0), F.lit(HOPS - 1)), start, step, lambda a: a["dst"])
    edges = e.select("src", target.alias("dst"), F.lit("uses").alias("relationship"), "pos").where("src <> dst")
    return Graph(nodes, edges)


def sample_graph(spark: SparkSession) -> Graph:
    """A small workspace to try things on: a folder with a library, a parser and a test."""
    nodes = [(0, "src", "Directory", "src"), (1, "lib.rs", "File", "src/lib.rs"), (2, "parser.rs", "File", "src/parser.rs"), (3, "parser_test.rs", "Test", "src/parser_test.rs")]
    edges = [(0, 1, "contains"), (0, 2, "contains"), (0, 3, "contains"), (1, 2, "uses"), (3, 2, "imports")]
    return Graph(spark.createDataFrame([(i, i, n, k, p) for i, n, k, p in nodes], "id long, pos long, name string, kind string, path string"), spark.createDataFrame([(*e, k) for k, e in enumerate(edges)], "src long, dst long, relationship string, pos long"))


def lattice(spark: SparkSession, width: int, height: int) -> Graph:
    """A torus of width x height cells, each linked with its eight neighbours once, from the smaller id."""
    n = width * height
    nodes = spark.range(n).select("id", F.col("id").alias("pos"), F.format_string("cell_%d_%d", F.pmod("id", F.lit(width)), F.floor(F.col("id") / width)).alias("name"), F.lit("Other").alias("kind"), F.pmod("id", F.lit(width)).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    nodes = nodes.withColumn("path", F.col("name")).withColumn("metadata", F.create_map(F.lit("x"), F.col("x").cast("string"), F.lit("y"), F.col("y").cast("string")))
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)])
    to = F.pmod(F.col("y") + F.col("d.dy"), F.lit(height)) * width + F.pmod(F.col("x") + F.col("d.dx"), F.lit(width))
    edges = nodes.select("id", "x", "y", F.explode(around).alias("d")).select(F.col("id").alias("src"), to.cast("long").alias("dst")).where("src < dst").distinct()
    return Graph(nodes, edges.select("src", "dst", F.lit("neighbor").alias("relationship"), (F.col("src") * n + F.col("dst")).alias("pos")))


def architect(g: Graph, strategy: str, root: str = "new", width: int = 16) -> Graph:
    """A graph laid out anew: preserve, flat, lattice; modular is flat."""
    makers = {"preserve": preserve, "flat": flat, "modular": flat, "lattice": lambda x, r: grid(x, r, width)}
    if strategy not in makers:
        raise ValueError(f"no such strategy: {strategy}")
    return makers[strategy](g, root)


def preserve(g: Graph, root: str) -> Graph:
    """The same tree under a new root, the common prefix of all paths cut off."""
    from .joins import common_prefix

    prefix = F.broadcast(common_prefix(g.nodes).withColumnRenamed("root", "__prefix"))
    rest = F.regexp_replace(F.expr("substring(path, length(__prefix) + 1)"), "^/", "")
    nodes = g.nodes.join(prefix).withColumn("path", F.concat_ws("/", F.lit(root), F.nullif(rest, F.lit("")))).drop("__prefix")
    return Graph(nodes, g.edges).clean()


def flat(g: Graph, root: str) -> Graph:
    """All that is no directory, once for each name, right under the root."""
    from .search import first_by_name

    return Graph(first_by_name(g.nodes).withColumn("path", F.concat(F.lit(root + "/"), "name")), g.edges).clean()


def grid(g: Graph, root: str, width: int) -> Graph:
    """Places by metadata x and y, else by pos; all edges become uses."""
    have = "metadata" in g.nodes.columns
    at = lambda k, other: F.coalesce(F.col("metadata")[k].try_cast("long") if have else F.lit(None).cast("long"), other)
    nodes = g.nodes.withColumn("gx", at("x", F.pmod("pos", F.lit(width)))).withColumn("gy", at("y", F.floor(F.col("pos") / width)))
    nodes = nodes.withColumn("path", F.concat(F.lit(root), F.lit("/row_"), "gy", F.lit("/"), "name"))
    return Graph(nodes, g.edges.withColumn("relationship", F.lit("uses"))).clean()


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
