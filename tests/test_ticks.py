"""Semi-naive ticks and pushed ranks against plain rounds over everything, and what is left on disk."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.graph import Graph
from skein.operators import automaton as A
from skein.operators import tables
from skein.operators import traversal as T
from skein.session import shared_top

RULES = {
    "default": A.default_rules, "described": A.description_rules, "impact": lambda: A.Registry(A.ImportPropagation(0.5, 0.05, 0.9), A.ModuleActivation()),
    "life": lambda: A.Registry(A.Life()), "noop": lambda: A.Registry(A.NoOp()), "none": A.Registry, "late": lambda: A.Registry(A.Delegate(F.col("changed"), A.ImportPropagation()), A.ComplexityTracking()),
}


def random_graph(spark, seed, n=60, m=90):
    draw = random.Random(seed)
    nodes = [(i, i, f"n{i}", "File", f"a/n{i}.rs") for i in range(n)]
    edges = [(draw.randrange(n // 2), draw.randrange(n), draw.choice(["uses", "imports", "contains", "other"]), k) for k in range(m)]
    return Graph(spark.createDataFrame(nodes, "id long, pos long, name string, kind string, path string"), spark.createDataFrame(edges, "src long, dst long, relationship string, pos long"))


def rows(state):
    return sorted((r.id, r.activation, r.payload, r.changed, r.stability) for r in state.collect())


@pytest.mark.parametrize("name", sorted(RULES))
def test_ticks_equal_full_ticks(spark, name, monkeypatch):
    monkeypatch.setattr(A, "DENSE", 1)  # as often as can be only near nodes are asked
    g = random_graph(spark, len(name))
    start = tables.cut(A.initial_state(g.nodes, F.when(F.col("id") % 13 == 0, 0.9).otherwise(0.0), F.col("id") % 17 == 0, F.lit(0.4)))
    run = A.Automaton(g, RULES[name](), start)
    plain, asked = start, []
    ask = run._ask
    run._ask = lambda *a, **k: asked.append(k["only_near"]) or ask(*a, **k)
    for _ in range(6):
        told = run.step()
        done = tables.cut(A.evaluate(plain, run.adjacency, RULES[name]().by_priority())) if RULES[name]().rules else None
        moved = done.where("outcome IS NOT NULL").count() if done else 0
        plain = tables.cut(A.applied(done)) if done else plain
        assert rows(run.state) == rows(plain) and (told.transitions, told.skipped) == (moved, 60 - moved)
        assert told.avg_activation == pytest.approx(np.mean([r[1] for r in rows(plain)]))
    assert name in ("noop", "none") or True in asked


def test_ticks_follow_new_states_and_rules(spark):
    g = random_graph(spark, 4)
    run = A.Automaton(g, A.Registry(A.Life()), A.initial_state(g.nodes))
    assert not run.run_ticks(2).history[-1].had_transitions
    run.state = A.seeded(run.state, F.col("id") < 30, 1.0)
    assert run.step().had_transitions
    assert run.step(A.NoOp()).transitions == 60 and run.reset().step(A.NoOp()).tick == 1


class Falls(A.Rule):
    """Nodes at 1 whose id is divisible by 7 leave it, and come back."""

    id, priority, reads = "falls", 20, ()

    def apply(self):
        return F.when(F.col("id") % 7 == 0, A.outcome(F.when(F.col("activation") == 1, 0.4).otherwise(F.col("activation") + 0.3)))


class Flips(A.Rule):
    """Flags that come and go."""

    id, priority, reads = "flips", 20, ()

    def apply(self):
        return F.when((F.col("id") % 9 == 0) & (F.col("activation") > 0.6), A.outcome(F.col("activation") - 0.5, changed=~F.col("changed")))


@pytest.mark.parametrize("extra, large", [(None, 1 << 40), (None, 1), (Falls, 1 << 40), (Flips, 1 << 40)])
def test_nodes_with_a_neighbour_at_one_are_not_summed_again(spark, extra, large, monkeypatch):
    """States as of plain ticks over all edges, while the edges that ticks join become few (unless nodes leave 1 in each tick)."""
    monkeypatch.setattr(tables, "LARGE", large)
    monkeypatch.setattr(A, "OPEN", 1.0)  # as soon as can be
    rules = A.description_rules()
    if extra:
        rules.register(extra())
    g = random_graph(spark, 21, 90, 400)
    start = tables.cut(A.initial_state(g.nodes, F.when(F.col("id") % 13 == 0, 1.0).otherwise(F.col("id") / 2000), F.col("id") % 13 == 0, F.lit(0.4)))
    run, plain, joined, messages = A.Automaton(g, rules, start), start, [], A.messages
    every = run.adjacency.count()
    for _ in range(8):
        monkeypatch.setattr(A, "messages", lambda adjacency, state: (joined.append(adjacency.count()), messages(adjacency, state))[1])
        told = run.step()
        monkeypatch.setattr(A, "messages", messages)
        done = tables.cut(A.evaluate(plain, run.adjacency, rules.by_priority()))
        plain = tables.cut(A.applied(done))
        got, want = rows(run.state), rows(plain)
        assert [r[0:1] + r[2:] for r in got] == [r[0:1] + r[2:] for r in want]
        assert [r[1] for r in got] == pytest.approx([r[1] for r in want], abs=1e-12)
        assert told.transitions == done.where("outcome IS NOT NULL").count()
    assert joined[0] == every
    assert extra or joined[-1] < 0.8 * every, joined


def ranks(n, edges, damping, rounds):
    out = np.bincount([s for s, _ in edges], minlength=n)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        given = np.zeros(n)
        for s, d in edges:
            if d < n:
                given[d] += x[s] / out[s]
        x = (1 - damping) / n + damping * (given + x[out == 0].sum() / n)
    return x


@pytest.mark.parametrize("shape", ["random", "cycle", "star", "tree", "no edges"])
def test_pushed_ranks_equal_rounds(spark, shape, monkeypatch):
    draw, n = random.Random(2), 40
    edges = {"random": [(draw.randrange(n), draw.randrange(n + 3)) for _ in range(100)], "cycle": [(i, (i + 1) % n) for i in range(n)] + [(0, 20)], "star": [(i, 0) for i in range(1, n)] * 2 + [(0, 1)], "tree": [((i - 1) // 3, i) for i in range(1, n)], "no edges": []}[shape]
    nodes = spark.range(n).selectExpr("id", "id AS pos", "'x' AS name", "'File' AS kind", "'x' AS path")
    g = Graph(nodes, spark.createDataFrame([(s, d, "uses", k) for k, (s, d) in enumerate(edges)], "src long, dst long, relationship string, pos long"))
    want = ranks(n, edges, 0.85, 20)
    for large in (1, 1 << 40):
        monkeypatch.setattr(tables, "LARGE", large)
        got = {r.id: r["rank"] for r in T.pagerank(g).collect()}
        assert len(got) == n and max(abs(got[i] - want[i]) for i in range(n)) < 1e-9


def test_rounds_over_buckets_shuffle_sums_only(spark):
    shares = tables.cut(spark.range(1000).selectExpr("id AS src", "id % 7 AS dst", "1.0 AS share"), by="src")
    given = tables.cut(spark.range(1000).selectExpr("id", "1.0 AS given"), by="id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = given.join(shares, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum("share").alias("s"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        tables.free(shares, given)


def test_long_runs_leave_little(spark):
    """Of any number of ticks or rounds at most two tables stay."""
    top = shared_top(spark).removeprefix("file://")
    count = lambda: sum(f.startswith("table-") for f in os.listdir(top))
    g = random_graph(spark, 9)
    before = count()
    run = A.Automaton(g, A.default_rules(), A.initial_state(g.nodes, F.when(F.col("id") == 0, 1.0).otherwise(0.0)))
    run.run_ticks(7)
    assert count() - before <= 3  # the adjacency, the last states and those before
    before = count()
    assert T.pagerank(g).count() == 60 and count() - before <= 1


def test_adjacency_sums_each_pair_once(spark):
    """Against a sum over both ends of every edge: loops, parallel edges, either direction, ties of pos."""
    draw = random.Random(3)
    rows = [(draw.randrange(12), draw.randrange(12), draw.choice(["uses", "imports", "contains"]), draw.randrange(3)) for _ in range(200)] + [(None, 1, "uses", 0), (1, None, "uses", 0)]
    g = Graph(spark.range(12).select("id"), spark.createDataFrame(rows, "src long, dst long, relationship string, pos long"))
    want = {}
    for src, dst, kind, pos in rows[:200]:
        for at in {(src, dst), (dst, src)}:
            want[at] = min(want.get(at, (pos, kind)), (pos, kind))
    found = [((r.id, r.peer), r.relationship) for r in g.adjacency().collect()]
    assert len(found) == len(want) and dict(found) == {k: v[1] for k, v in want.items()}


def test_a_model_needs_no_automaton_tables(spark, monkeypatch):
    """States of a run that makes no tick are asked without its adjacency being laid out, and in turn each neighbour is met once."""
    from skein.samplers import ModelRule

    g = Graph(spark.range(6).select("id"), spark.createDataFrame([(k, k + 1, "uses", k) for k in range(5)], "src long, dst long, relationship string, pos long"))
    run = A.Automaton(g, A.Registry(), A.initial_state(g.nodes, 0.5))
    assert "adjacency" not in vars(run)
    met, prompts = [], ModelRule._prompts
    monkeypatch.setattr(ModelRule, "_prompts", lambda self, near, *a: (met.append(near.count()), prompts(self, near, *a))[1])
    ModelRule(lambda p: ["{}" for _ in p]).tick_in_turn(run.graph, run.state)
    assert len(met) == 6 and sum(met) == 10


@pytest.mark.parametrize("name", ["j22_impact_report", "g2_impact_ranking"])
def test_reports_make_their_description_once(spark, sf, name, monkeypatch):
    """The run and the report read one written table, so that degrees are not summed for each."""
    import __spark_entry__

    class Seen(Exception):
        pass

    def seen(g, config, *a):
        raise Seen(config)

    monkeypatch.setattr(A, "with_description", seen)
    with pytest.raises(Seen) as found:
        __spark_entry__.queries()[name](spark, sf)
    assert getattr(found.value.args[0], "cut_folder", None)
