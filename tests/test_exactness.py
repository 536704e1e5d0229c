"""Operators against plain Python: what SQL can't say, or says by the same joins."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.graph import Graph
from skein.operators import automaton as A
from skein.operators import cell_tree, tables
from skein.operators import joins as J
from skein.operators import layout as L
from skein.operators import planning as P
from skein.operators import traversal as T
from skein.plans.finer import _mean
from skein.protocols import FileMaterializer
from skein.samplers import ModelRule
from skein.streaming import changes

NODES = "id long, pos long, name string, kind string, path string"
EDGES = "src long, dst long, relationship string, pos long"


def graph_of(spark, nodes, edges=()):
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame([(*e, k) for k, e in enumerate(edges)], EDGES))


def test_a_stem_is_held_anywhere_in_a_test_path(spark):
    """Inside a word, in a folder's name, of one or two characters; by brute force over random paths too."""
    rng = random.Random(4)
    files = ["src/score.py", "src/api.py", "x/ab.py", "y/q.py", "src/.hidden", "src/none_such.py", "tests/é.py", "s/a%b_c.py"]
    files += ["m/" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + ".py" for _ in range(60)]
    tests = ["tests/test_scores.py", "t/test_rapid_apikey.py", "tests/score/test_x.py", "t/crab.py", "t/é_test.py", "t/a%b_c_test.py"]
    tests += ["t/" + "".join(rng.choice("abc_") for _ in range(rng.randint(1, 12))) + ".py" for _ in range(60)]
    nodes = [(k, k, p.rsplit("/", 1)[-1], "File", p) for k, p in enumerate(files)] + [(1000 + k, k, p.rsplit("/", 1)[-1], "Test", p) for k, p in enumerate(tests)]
    g = graph_of(spark, nodes, [(1000, 5, "uses")])
    stem = lambda p: (n := p.rsplit("/", 1)[-1])[: n.rfind(".")] if "." in (n := p.rsplit("/", 1)[-1])[1:] else n
    want = {(k, 1000 + t) for k, p in enumerate(files) for t, q in enumerate(tests) if stem(p) in q} | {(5, 1000)}
    got = {(r.id, r.test) for r in J.nearby_tests(g, g.nodes.where("kind = 'File'")).collect()}
    assert got == want and {(0, 1000), (0, 1002), (1, 1001), (2, 1003), (6, 1004), (7, 1005)} <= got
    near = {r.id for r in P.test_signal(g, g.nodes.where("kind = 'File'")).collect()}
    assert near == {k for k, _ in want}


def test_metadata_says_that_a_node_has_tests(spark):
    rows = [(1, "a.py", "a.py", "true"), (2, "b.py", "b.py", "false"), (3, "c.py", "c.py", None)]
    nodes = spark.createDataFrame(rows, "id long, name string, path string, t string").select("id", F.col("id").alias("pos"), "name", F.lit("File").alias("kind"), "path", F.when(F.col("t").isNotNull(), F.create_map(F.lit("has_tests"), F.col("t"))).alias("metadata"))
    g = Graph(nodes, spark.createDataFrame([], EDGES))
    assert [r.id for r in P.test_signal(g, g.nodes).collect()] == [1]
    got = {r.id: (r.has_test, r.strategy) for r in P.migration_candidates(g).collect()}
    assert got[1][0] and not got[2][0] and got[1][1] != "TranspileTestsFirst" == got[3][1]


def test_asking_in_turn_is_asking_one_by_one(spark):
    rng = random.Random(2)
    edges = sorted({(rng.randrange(30), rng.randrange(30)) for _ in range(60)})
    g = graph_of(spark, [(k, k, f"n{k}", "File", f"n{k}") for k in range(30)], [(a, b, "uses") for a, b in edges])
    state = A.initial_state(g.nodes, F.when(F.col("id") % 7 == 3, 1.0).otherwise(0.0))
    near = {k: ({a for a, b in edges if b == k} | {b for a, b in edges if a == k}) for k in range(30)}
    value = {k: float(k % 7 == 3) for k in range(30)}
    for k in range(30):
        value[k] = math.floor(round(sum(value[p] for p in near[k]) / len(near[k]), 6) * 64) / 64 if near[k] else 0.0
    got = {r.id: r.activation for r in ModelRule(_mean).tick_in_turn(g, state).collect()}
    assert got == value
    answers, history = ModelRule(lambda prompts: ["?" for _ in prompts]).run(g, state, most=2)
    assert history == [(0, 30), (0, 30)] and answers.count() == 30
    assert ModelRule(lambda prompts: ['{"activation": 0.5}' for _ in prompts]).run(g, state, in_turn=True)[1] == [(30, 0), (0, 0)]


def brute_push(places, strength):
    d = places[:, None, :] - places[None, :, :]
    d2 = (d * d).sum(axis=2) + cell_tree.SOFT
    return (d * (strength / (d2 * np.sqrt(d2)))[:, :, None]).sum(axis=1)


@pytest.mark.parametrize("axes", [("x", "y"), ("x", "y", "z")])
def test_trees_and_joins_push_alike(spark, monkeypatch, axes):
    """As a flat tree, by joins, and with theta 0 exactly as by brute force; coincident places too."""
    rng = np.random.default_rng(1)
    places = rng.normal(0, 50, (120, len(axes)))
    places[100:] = places[:20]
    frame = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(places)], "id long, " + ", ".join(f"{a} double" for a in axes))
    low, side = places.min(axis=0), float((places.max(axis=0) - places.min(axis=0)).max() * 1.1)
    own = cell_tree.CellTree.of_places(places, 16, side, low)
    forces = lambda theta: np.asarray([tuple(r)[1:] for r in cell_tree.repulsion(frame, axes, 16, side, tuple(map(float, low)), theta, 100.0).orderBy("id").collect()])
    near, exact = forces(0.8), forces(0.0)
    assert exact == pytest.approx(brute_push(places, 100.0)) and own.push(places, 0.0, 100.0) == pytest.approx(exact) and own.push(places, 0.8, 100.0) == pytest.approx(near)
    assert np.abs(near - exact).sum() < 0.1 * np.abs(exact).sum()
    monkeypatch.setattr(cell_tree, "TREE_CELLS", 5)
    assert forces(0.8) == pytest.approx(near)


@pytest.mark.parametrize("axes", [("x", "y"), ("x", "y", "z")])
def test_a_large_tree_is_met_by_blocks(spark, monkeypatch, axes):
    """Many small blocks, and more places at one point than a block holds; no join or unfolding makes a row for a place and a cell."""
    from test_common_names import most_rows

    places = np.random.default_rng(3).normal(0, 50, (600, len(axes)))
    places[500:] = places[0]
    frame = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(places)], "id long, " + ", ".join(f"{a} double" for a in axes)).repartition(2)
    low, side = places.min(axis=0), float((places.max(axis=0) - places.min(axis=0)).max() * 1.1)
    want = cell_tree.CellTree.of_places(places, 12, side, low).push(places, 0.8, 100.0)
    monkeypatch.setattr(cell_tree, "TREE_CELLS", 5)
    monkeypatch.setattr(cell_tree, "BLOCK", 30)
    rows = []
    monkeypatch.setattr(cell_tree, "cut", lambda df: rows.append((out := tables.cut(df)).count()) or out)
    found = cell_tree.repulsion(frame, axes, 12, side, tuple(map(float, low)), 0.8, 100.0)
    assert np.asarray([tuple(r)[1:] for r in found.orderBy("id").collect()]) == pytest.approx(want, rel=1e-4, abs=1e-5)
    assert max(rows[1:]) < 600 * 12 and most_rows(found) < 600 * 40


def test_one_task_or_many_lay_out_alike(spark, monkeypatch):
    g = T.random_graph(spark, 80)
    start = L.start(g.nodes)
    places = lambda frame: {r.id: (round(r.x, 6), round(r.y, 6), round(r.vx, 6)) for r in frame.collect()}
    for config in (L.Config(), L.Config(barnes_hut=False)):
        one = places(L.run(start, g.edges, config, 3))
        monkeypatch.setattr(L, "ONE_TASK", 10)
        assert places(L.run(start, g.edges, config, 3)) == one
        monkeypatch.undo()
    assert L.run(start.limit(0), g.edges, steps=2).count() == 0 and L.run(start, g.edges.limit(0), steps=2).count() == 80
    monkeypatch.setattr(L, "BLOCK", 7)
    assert {r.id: round(r.fx, 6) for r in L.exact_repulsion(start, start.where("id < 30"), 10.0).collect()} == {k: v for k, v in {r.id: round(r.fx, 6) for r in L.exact_repulsion(start, start, 10.0).collect()}.items() if k < 30}


def test_generated_graphs(spark):
    g = T.scale_free_graph(spark, 2000, 3)
    edges = g.edges.collect()
    degree = np.bincount([x for e in edges for x in (e.src, e.dst)])
    assert all(e.dst < e.src for e in edges) and len(edges) > 5900 and degree.max() > 40 and np.median(degree) < 6
    r = T.random_graph(spark, 1000).edges.collect()
    assert len(r) == 3000 and all(e.src != e.dst for e in r) and np.bincount([e.dst for e in r], minlength=1000).max() < 15


def test_process_events_fold(spark):
    """By a loop over each process's events."""
    rng = random.Random(3)
    rows = [(p, k, rng.choice(["start", "exit", "change", "kill"]), rng.randint(0, 1), policy) for p, policy in enumerate(["never", "on_code_change", "on_crash", "always"] * 3) for k in range(25)]
    want = []
    for p in range(12):
        running, restarts = False, 0
        for _, seq, event, code, policy in [r for r in rows if r[0] == p]:
            again = running and (event == "change" and policy in ("on_code_change", "always") or event == "exit" and (policy == "always" or policy == "on_crash" and code != 0))
            restarts += again
            running = True if event == "start" else False if event == "kill" or event == "exit" and not again else running
            want.append((p, seq, running, again, restarts))
    frame = spark.createDataFrame(rows, "process int, seq int, event string, exit_code int, policy string")
    assert sorted(map(tuple, changes.process_states(frame).collect())) == want


def test_changes_stay_in_their_folder(spark, tmp_path):
    bad = spark.createDataFrame([("ok.txt", "x"), ("../out.txt", "y")], "path string, content string")
    with pytest.raises(PermissionError):
        FileMaterializer().apply_proposed_changes(bad, str(tmp_path))
    assert list(tmp_path.iterdir()) == []


@pytest.mark.parametrize("axes", [("x", "y"), ("x", "y", "z")])
def test_exact_pushes_make_no_row_a_pair(spark, monkeypatch, axes):
    """Many blocks on both sides; rows are places times blocks, whatever the pairs are."""
    from test_common_names import most_rows

    places = np.random.default_rng(2).normal(0, 50, (600, len(axes)))
    frame = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(places)], "id long, " + ", ".join(f"{a} double" for a in axes))
    monkeypatch.setattr(cell_tree, "PUSHING", 200)
    monkeypatch.setattr(cell_tree, "TREE_CELLS", 5)
    found = cell_tree.exact(frame, frame, axes, 100.0, pushed=150)
    assert np.asarray([tuple(r)[1:] for r in found.orderBy("id").collect()]) == pytest.approx(brute_push(places, 100.0))
    assert most_rows(cell_tree.repulsion(frame, axes, 16, 1000.0, (0.0,) * len(axes), 0.0, 100.0)) <= 600 * 8
    assert cell_tree.exact(frame.limit(0), frame, axes, 1.0).where("fx = 0").count() == 600 and cell_tree.exact(frame, frame.limit(0), axes, 1.0).count() == 0
