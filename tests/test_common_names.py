"""Path joins where many paths share a file name, against brute force and with a count of the rows they make."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skein.graph import Graph
from skein.operators import joins as J
from skein.operators import traversal as T


def strip(p):
    return re.sub(r"^(\./)+", "", p)


def plain_resolve(routes, paths):
    """paths: (id, pos, path); route to (target, strategy)."""
    out = {}
    for route in routes:
        norm = strip(route)
        last = norm.split("/")[-1]
        if not last:
            continue
        best = None
        for i, pos, path in paths:
            npath = strip(path)
            k = 1 if path.endswith(route) else 2 if npath.endswith(norm) else 3 if f"/{norm}/" in f"/{npath}/" else 4 if npath.split("/")[-1] == last else None
            if k and (best is None or (k, pos, i) < best):
                best = (k, pos, i)
        if best:
            out[route] = (best[2], best[0])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_routes_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    word = lambda: draw.choice(["a", "b", "ab", "ba", "mod.rs", "x.py", "", "aab"])
    path = lambda: draw.choice(["", "", "", "./", "././"]) + "/".join(word() for _ in range(draw.randrange(1, 5)))
    paths = [(k, draw.randrange(90), path()) for k in range(120)]
    routes = sorted({path() for _ in range(150)} | {"/x.py", "./mod.rs", "od.rs", "b/mod.rs"} - {""})
    nodes = spark.createDataFrame(paths, "id long, pos long, path string")
    refs = spark.createDataFrame([(-1, r, "uses") for r in routes], "source_id long, route string, kind string")
    assert {r.route: (r.target_id, r.strategy) for r in J.resolve_routes(refs, nodes).collect()} == plain_resolve(routes, paths)


def most_rows(df):
    """The largest number of rows that a join or an unfolding of the plan makes when it runs."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    found, todo = [0], [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        rows = node.metrics().get("numOutputRows")
        if rows.isDefined() and re.search("Join|Generate", node.nodeName()):
            found.append(rows.get().value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return max(found)


def test_a_file_name_that_all_paths_share(spark):
    n = 20_000
    nodes = spark.range(n).select("id", F.col("id").alias("pos"), F.concat(F.lit("src/"), F.concat(F.lit("m"), "id"), F.lit("/mod.rs")).alias("path"))
    refs = spark.range(n).select(F.col("id").alias("source_id"), F.concat(F.lit("m"), (F.col("id") + 1) % n, F.lit("/mod.rs")).alias("route"), F.lit("uses").alias("kind"))
    found = J.resolve_routes(refs, nodes).cache()
    assert found.count() == n and found.where((F.col("target_id") == (F.col("source_id") + 1) % n) & (F.col("strategy") == 1)).count() == n
    assert most_rows(J.resolve_routes(refs, nodes)) <= 5 * n  # paths by their depth, and by the lengths of routes' first parts


def test_stems_that_many_nodes_share(spark):
    """10 stems of 20,000 nodes: candidates are what holds them, not every test that shares a run of characters."""
    nodes = spark.range(20_000).select("id", F.concat(F.lit("src/"), "id", F.lit("/common_part_"), F.col("id") % 10, F.lit(".rs")).alias("path"), F.lit("File").alias("kind"))
    tests = spark.range(3000).select((F.col("id") + 50_000).alias("id"), F.concat(F.lit("tests/common_"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("part_"), (F.col("id") / 100).cast("int") % 10)).otherwise(F.lit("other")), F.lit("_"), F.col("id"), F.lit(".rs")).alias("path"), F.lit("Test").alias("kind"))
    matches = J.stem_matches(tests, nodes)
    want = sum(f"common_part_{k}" in f"tests/common_part_{i // 100 % 10}_{i}.rs" for k in range(10) for i in range(0, 3000, 100))
    assert matches.count() == want == 30
    g = Graph(nodes.unionByName(tests).withColumn("pos", F.col("id")).withColumn("name", F.lit("x")), spark.createDataFrame([], "src long, dst long, relationship string, pos long"))
    assert J.with_tests(g, nodes).count() == 20_000


def test_changed_paths_by_whole_components(spark):
    nodes = spark.createDataFrame([(1, "b/c.rs", "c.rs"), (2, "a/b/c.rs", "z"), (3, "xb/c.rs", "q"), (4, "c.rs", "r"), (5, "other", "k")], "id long, path string, name string")
    changed = lambda *p: spark.createDataFrame([(x,) for x in p], "changed string")
    got = lambda *p: {r.id for r in J.match_changed(nodes, changed(*p)).collect()}
    assert got("w/a/b/c.rs") == {1, 2, 4} and got("z") == {2} and got("b/c.rs") == {1} and got("y/b/c.rs", "k") == {1, 4, 5} and got("nothing") == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_stems_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    word = lambda most: "".join(draw.choice("ab_é😀.") for _ in range(draw.randrange(most)))
    tests = [(k, "/".join(word(9) for _ in range(draw.randrange(1, 4)))) for k in range(60)] + [(90, None), (91, "")]
    nodes = [(k, draw.choice(["", "src/", "a/b/"]) + word(6)) for k in range(200)] + [(300, "x/" + "ab" * 4), (301, None)]
    stem = lambda p: re.sub(r"(?<=.)\.[^.]*$", "", p.split("/")[-1])
    t, n = spark.createDataFrame(tests, "id long, path string"), spark.createDataFrame(nodes, "id long, path string")
    want = {(s, i) for s in {stem(p) for _, p in nodes if p is not None} - {""} for i, p in tests if p is not None and s in p}
    found = [(r.stem, r.test) for r in J.stem_matches(t, n).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert sorted(r.stem for r in J.known_stems(t, n).collect()) == sorted({s for s, _ in want})


def test_stems_whose_runs_all_tests_share(spark):
    """Every stem shares most of its runs with every test: rows grow with the tests' characters, not with stems times tests."""
    n = 20_000
    nodes = spark.range(n).select("id", F.concat(F.lit("src/doc_"), F.col("id") + n, F.lit(".rs")).alias("path"))
    tests = spark.range(n).select("id", F.concat(F.lit("src/test_doc_"), F.col("id") + n, F.lit(".rs")).alias("path"))
    assert J.stem_matches(tests, nodes).count() == n
    assert most_rows(J.stem_matches(tests, nodes)) <= 25 * n


def test_impact_counts_only_what_it_found(spark):
    """Edges elsewhere are not unfolded to their ends, nor nodes elsewhere joined."""
    nodes = spark.range(3000).select("id", F.col("id").alias("pos"))
    edges = spark.range(3, 2999).select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"), F.lit("uses").alias("relationship"), F.lit(0).alias("pos"))
    edges = edges.unionByName(spark.createDataFrame([(1, 0, "uses", 0), (2, 1, "uses", 0), (5, 1, "contains", 0)], edges.schema))
    found = T.impact(Graph(nodes, edges), nodes.where("id = 0"))
    assert most_rows(found) <= 10
    assert [(r.id, r.depth, r.in_degree) for r in found.collect()] == [(1, 1, 1), (2, 2, 0)]
