"""Edges joined to nodes, and paths joined to paths. Suffix and prefix joins are turned into equi-joins on a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import CONTAINS, Graph


def neighbors(g: Graph, node_id: int) -> DataFrame:
    """peer and edge of each edge at a node; parallel edges stay, a loop counts once."""
    own = g.edges.where((F.col("src") == node_id) | (F.col("dst") == node_id)).withColumn("id", F.when(F.col("src") == node_id, F.col("dst")).otherwise(F.col("src")))
    return own.join(g.nodes.select("id", "name", "kind"), "id").withColumnRenamed("id", "peer")


def neighborhood(g: Graph, state: DataFrame) -> DataFrame:
    """id, direction, peer, activation: both ends' states over all edges; state: id, activation."""
    peer = state.select(F.col("id").alias("peer"), "activation")
    inward = g.edges.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("src").alias("peer"))
    outward = g.edges.select(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("dst").alias("peer"))
    return inward.unionByName(outward).join(peer, "peer").select("id", "direction", "peer", "activation")


def all_neighbors(g: Graph, relationship: str | None = None) -> DataFrame:
    """Distinct (id, peer) over both directions."""
    pairs = g.both_ways()
    return (pairs.where(F.col("relationship") == relationship) if relationship else pairs).select("id", "peer").distinct()


def dependencies(g: Graph, node_id: int, direction: str = "both") -> DataFrame:
    """direction, relationship and the other node of each edge at a node."""
    parts = []
    if direction in ("in", "both"):
        parts.append(g.edges.where(F.col("dst") == node_id).select(F.lit("in").alias("direction"), "relationship", F.col("src").alias("id")))
    if direction in ("out", "both"):
        parts.append(g.edges.where(F.col("src") == node_id).select(F.lit("out").alias("direction"), "relationship", F.col("dst").alias("id")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.join(g.nodes.select("id", "name", "kind", "path"), "id")


def parent_path(path: str | Column) -> Column:
    """Up to the last slash; null for a top-level name."""
    c = F.col(path) if isinstance(path, str) else path
    return F.nullif(F.regexp_extract(c, r"^(.*)/[^/]*$", 1), F.lit(""))


def hierarchy(nodes: DataFrame) -> DataFrame:
    """contains-edges from each path's parent directory to it."""
    folders = nodes.where("kind = 'Directory'").select(F.col("id").alias("src"), F.col("path").alias("parent"))
    return nodes.select(F.col("id").alias("dst"), parent_path("path").alias("parent")).join(folders, "parent").where("src <> dst").select("src", "dst", F.lit(CONTAINS).alias("relationship"))


def _split(route: Column) -> Column:
    """A route as the file name or rest after its first slash, and what stands before it."""
    slash = F.instr(route, "/")
    rest = F.when(slash > 0, F.substring(route, slash + 1, F.length(route))).otherwise("")
    return F.struct(rest.alias("rest"), F.when(slash > 0, F.substring(route, F.lit(1), slash - 1)).otherwise(route).alias("first"))


def _first_by_suffix(paths: DataFrame, text: str, routes: DataFrame, route: str) -> DataFrame:
    """routes (route, ..) whose ``route`` column ends some path's ``text``, with the first of these by pos: route, b.

    The index has a row for each component of a path: the component and what follows it. A route must equal what follows, and its
    own first part, which may begin inside a component, that component's end. Only the first path of each key is kept, before
    routes are joined, so a file name that all paths share gives a route one row.
    """
    parts = F.split(text, "/")
    places = F.sequence(F.lit(1), F.size(parts))
    suffixes = F.transform(places, lambda i: F.struct(F.element_at(parts, i).alias("own"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rest")))
    index = paths.select("pos", "id", F.explode(suffixes).alias("s")).select("pos", "id", "s.own", "s.rest")
    asked = routes.select("route", _split(F.col(route)).alias("s")).select("route", "s.rest", "s.first")
    wanted = asked.select("rest", F.length("first").alias("n")).distinct()
    ends = index.join(wanted, "rest").where(F.length("own") >= F.col("n")).withColumn("first", F.expr("right(own, n)"))
    best = ends.groupBy("rest", "first").agg(F.min(F.struct("pos", "id")).alias("b"))
    return asked.join(best, ["rest", "first"]).select("route", "b")


def resolve_routes(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs (source_id, route, kind) with the node each route means: source_id, route, kind, target_id, strategy.

    1: the path ends with the route; 2: so after "./" is cut off both; 3: the route's components stand in the path in a row;
    4: the file names are equal. The least strategy, then the least pos. Each strategy is an equi-join of the distinct routes on
    an index that has one path, the first, for each key: suffixes for 1 and 2, runs of as many components as routes have for 3,
    file names for 4. Unresolved and self references are dropped.
    """
    r = refs.withColumn("norm", F.regexp_replace("route", r"^(\./)+", "")).withColumn("last", F.element_at(F.split("norm", "/"), -1)).where("last <> ''")
    routes = r.select("route", "norm", "last").distinct()
    paths = nodes.select("id", "pos", "path").withColumn("npath", F.regexp_replace("path", r"^(\./)+", ""))
    parts, first = F.split("npath", "/"), F.min(F.struct("pos", "id")).alias("b")
    counts = routes.select(F.size(F.split("norm", "/")).alias("m")).distinct()
    runs = paths.join(F.broadcast(counts), F.size(parts) >= F.col("m")).select("pos", "id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - F.col("m") + 1), lambda i: F.array_join(F.slice(parts, i, F.col("m")), "/"))).alias("norm"))
    names = paths.select("pos", "id", F.element_at(parts, -1).alias("last"))
    found = [
        _first_by_suffix(paths, "path", routes, "route"), _first_by_suffix(paths, "npath", routes, "norm"),
        routes.join(runs.groupBy("norm").agg(first), "norm").select("route", "b"), routes.join(names.groupBy("last").agg(first), "last").select("route", "b"),
    ]
    every = None
    for strategy, rows in enumerate(found, 1):
        rows = rows.select("route", F.struct(F.lit(strategy).alias("strategy"), "b.pos", "b.id").alias("b"))
        every = rows if every is None else every.unionByName(rows)
    best = every.groupBy("route").agg(F.min("b").alias("b"))
    return refs.join(best, "route").select("source_id", "route", "kind", F.col("b.id").alias("target_id"), F.col("b.strategy").alias("strategy")).where("source_id <> target_id")


def match_changed(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids of nodes that a changed path names: equal to name or path, else one's components end with the other's."""
    exact = nodes.join(changed, nodes.path == changed.changed, "left_semi").select("id").unionByName(nodes.join(changed, nodes.name == changed.changed, "left_semi").select("id")).distinct()
    known = nodes.select(F.explode(F.array("path", "name")).alias("changed"))
    left = changed.join(known, "changed", "left_anti")
    # Whole-component suffixes of either side, unfolded, meet the other side whole: no row for a shared file name alone.
    tails = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/"))), "/")))
    longer = nodes.select("id", tails(F.col("path")).alias("changed")).join(left, "changed", "left_semi").select("id")
    shorter = nodes.select("id", "path").join(left.select(tails(F.col("changed")).alias("path")).distinct(), "path", "left_semi").select("id")
    suffix = longer.unionByName(shorter)
    return exact.unionByName(suffix).distinct()


def tested(g: Graph, inline: DataFrame | None = None) -> DataFrame:
    """Ids that have a test: inline ones, and targets of any edge from a node of kind Test."""
    tests = g.nodes.where("kind = 'Test'").select(F.col("id").alias("src"))
    out = g.edges.join(tests, "src", "left_semi").select(F.col("dst").alias("id"))
    return (out.unionByName(inline.select("id")) if inline is not None else out).distinct()


def stem(path: str | Column) -> Column:
    """The file name up to its last dot; a leading dot is part of it."""
    return F.regexp_replace(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


GRAM = 3


def _pieces(tests: DataFrame, stems: DataFrame) -> DataFrame:
    """stem, test: runs of characters of the tests' paths that may be stems, with the test; stems: stem, distinct.

    A stem has no slash, so it lies within one component of a path. At each place of a component stand runs of the lengths that
    stems with the place's first GRAM characters have, and of no other length: a table of these lengths, which has a row for each
    start and length of stems, is joined on the start.
    """
    n = F.least(F.lit(GRAM), F.length("stem"))
    wanted = stems.select(F.substring("stem", F.lit(1), n).alias("start"), F.length("stem").alias("n")).distinct()
    starts = F.broadcast(wanted.select(F.length("start").alias("k")).distinct())  # GRAM rows at most
    parts = tests.select(F.col("id").alias("test"), F.explode(F.array_distinct(F.split("path", "/"))).alias("part")).join(starts, F.length("part") >= F.col("k"))
    at = parts.select("test", "part", "k", F.explode(F.sequence(F.lit(1), F.length("part") - F.col("k") + 1)).alias("at"))
    met = at.withColumn("start", F.substring("part", F.col("at"), F.col("k"))).join(wanted, "start").where(F.length("part") - F.col("at") + 1 >= F.col("n"))
    return met.select(F.substring("part", F.col("at"), F.col("n")).alias("stem"), "test")


def _stems(nodes: DataFrame) -> DataFrame:
    return nodes.select(stem("path").alias("stem")).where("stem <> ''").distinct()


def stem_matches(tests: DataFrame, nodes: DataFrame) -> DataFrame:
    """stem, test: the distinct stems of the nodes' paths and the tests whose path holds one anywhere, even inside a word.

    The runs of a test's path that may be stems meet the stems by equality. So rows are made by the length of the tests' paths, and
    for what is found: none for a test that shares a part of a stem only, nor any for each node of a stem.
    """
    stems = _stems(nodes)
    return _pieces(tests, stems).distinct().join(stems, "stem", "left_semi")


def known_stems(tests: DataFrame, nodes: DataFrame) -> DataFrame:
    """stem: those of the nodes' paths that some test's path holds; of tests that hold the same, one row meets the stem."""
    stems = _stems(nodes)
    return stems.join(_pieces(tests, stems).select("stem").distinct(), "stem", "left_semi")


def tests_by_stem(g: Graph, nodes: DataFrame) -> DataFrame:
    """id, test: tests whose path holds a node's stem."""
    return nodes.select("id", stem("path").alias("stem")).join(stem_matches(g.nodes.where("kind = 'Test'"), nodes), "stem").select("id", "test").distinct()


def with_tests(g: Graph, nodes: DataFrame) -> DataFrame:
    """Ids of ``nodes`` that have a test nearby (see nearby_tests): stems are resolved once, whatever nodes share them."""
    tests = g.nodes.where("kind = 'Test'")
    direct = g.edges.join(tests.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).join(nodes.select("id"), "id", "left_semi")
    known = known_stems(tests, nodes)
    return direct.unionByName(nodes.select("id", stem("path").alias("stem")).join(known, "stem", "left_semi").select("id")).distinct()


def nearby_tests(g: Graph, nodes: DataFrame | None = None) -> DataFrame:
    """id, test: of ``nodes`` (all but directories), the tests with an edge to each, and those by stem; a test's own path holds its stem."""
    own = nodes if nodes is not None else g.nodes.where("kind <> 'Directory'")
    tests = g.nodes.where("kind = 'Test'").select(F.col("id").alias("src"))
    direct = g.edges.join(tests, "src", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("test"))
    if nodes is not None:
        direct = direct.join(own.select("id"), "id", "left_semi")
    return direct.unionByName(tests_by_stem(g, own)).distinct()


def related_paths(g: Graph, node_id: int, outward: bool = True) -> DataFrame:
    """Distinct paths at the other end of a node's edges, containment left out, sorted."""
    here, there = ("src", "dst") if outward else ("dst", "src")
    ids = g.edges.where((F.col(here) == node_id) & (F.col("relationship") != CONTAINS)).select(F.col(there).alias("id"))
    return g.nodes.join(ids, "id", "left_semi").select("path").distinct().orderBy("path")


def collect_neighbors(g: Graph, node_id: int, outward: bool, most: int) -> DataFrame:
    """The first ``most`` distinct (path, relationship) in edge order."""
    here, there = ("src", "dst") if outward else ("dst", "src")
    own = g.edges.where(F.col(here) == node_id).select(F.col(there).alias("id"), "relationship", "pos").join(g.nodes.select("id", "path"), "id")
    return own.groupBy("path", "relationship").agg(F.min(F.struct("pos", "id")).alias("at")).orderBy("at", "relationship").limit(most).select("path", "relationship")


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths (path) with the deepest root (root) that is a whole-component prefix, null for none: an equi-join on ancestors."""
    parts = F.split("path", "/")
    ancestors = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("root")))).alias("a")).select("path", "a.*")
    best = ancestors.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", "depth").alias("root"))
    return paths.join(best, "path", "left").select(*paths.columns, "root")


def common_prefix(paths: DataFrame) -> DataFrame:
    """One row, root: the longest common path prefix by components. The least and the greatest path decide it."""
    a, b = F.split(F.min("path"), "/"), F.split(F.max("path"), "/")
    ends = paths.agg(a.alias("a"), b.alias("b"))
    same = F.transform(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda n: F.slice("a", 1, n) == F.slice("b", 1, n))
    return ends.select(F.array_join(F.slice("a", 1, F.size(F.filter(same, lambda x: x))), "/").alias("root"))


def ancestors(paths: DataFrame) -> DataFrame:
    """All parent directories of the paths, distinct."""
    parts = F.split("path", "/")
    return paths.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()


def remap(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends replaced by ids (old, new); edges without either are dropped."""
    src, dst = ids.select(F.col("old").alias("src"), F.col("new").alias("new_src")), ids.select(F.col("old").alias("dst"), F.col("new").alias("new_dst"))
    return edges.join(src, "src").join(dst, "dst").select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key, without a window: a struct's maximum is summed before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(order, *rest), order).alias("r")).select(key, "r.*")


def ranked(rows: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """A running number in this order. The caller bounds the rows: one task numbers them."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def adjacency_lists(edges: DataFrame, parts: int = 0) -> DataFrame:
    """id, direction (out, in), n and the first, by pos, of each node's neighbours: the lists stay rows, an edge each. ``parts``:
    over how many tasks the rows are dealt by id, if given.

    Edges of one pos are summed first, by numbers alone, which takes a hash; only what is left is sorted for the first.
    """
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("dst").alias("peer")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("src").alias("peer")))
    rows = edges.select("pos", F.explode(ends).alias("e")).select("pos", "e.*")
    few = (rows.repartition(parts, "id") if parts else rows).groupBy("id", "direction", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("peer").alias("peer"))
    return few.groupBy("id", "direction").agg(F.sum("n").alias("n"), F.min(F.struct("pos", "peer")).alias("f")).select("id", "direction", "n", F.col("f.peer").alias("first"))
