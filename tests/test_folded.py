"""Ticks over folded tables against ticks over all nodes."""

import pytest
from pyspark.sql import functions as F

from skein.operators import automaton as A
from skein.operators import tables
from test_ticks import Falls, random_graph, rows


class Sinks(A.Rule):
    """Nodes that came to 1 leave it."""

    id, priority, reads, alike = "sinks", 20, (), True

    def apply(self):
        return F.when((F.col("activation") == 1) & ~F.col("changed"), A.outcome(F.lit(0.4)))


@pytest.mark.parametrize("extra, large, stops", [(None, 1, 6), (Sinks, 1 << 40, 0), (Falls, 1 << 40, 5)])
def test_folded_ticks_equal_ticks_over_all(spark, extra, large, stops, monkeypatch):
    """With several nodes in one state, nodes not held that are neighbours, nodes that leave 1 and a run that ends while folded."""
    monkeypatch.setattr(tables, "LARGE", large)
    monkeypatch.setattr(A, "OPEN", 1.0)
    monkeypatch.setattr(A, "DENSE", 1)  # as early as can be
    monkeypatch.setattr(A, "FOLD", 1)
    rules = A.description_rules()
    if extra:
        rules.register(extra())
    g = random_graph(spark, 21, 90, 160)
    start = tables.cut(A.initial_state(g.nodes, F.when(F.col("id") % 13 == 0, 1.0).otherwise(F.col("id") % 3 / 2000), F.col("id") % 13 == 0, F.lit(0.4)))
    stable = (lambda h: len(h) == stops) if stops else (lambda h: False)
    run, plain, folded = A.Automaton(g, rules, start, max_ticks=7, stable=stable), A.Automaton(g, rules, start), []
    ask = run._ask
    monkeypatch.setattr(run, "_ask", lambda before, *a, **k: ("adjacency" in k and folded.append(before.count())) or ask(before, *a, **k))
    run.run()
    for _ in range(stops or 7):
        plain.step()
    got, want = rows(run.state), rows(plain.state)
    assert [r[0:1] + r[2:] for r in got] == [r[0:1] + r[2:] for r in want]
    assert [r[1] for r in got] == pytest.approx([r[1] for r in want], abs=1e-12)
    assert [(t.tick, t.transitions, t.skipped) for t in run.history] == [(t.tick, t.transitions, t.skipped) for t in plain.history]
    assert [t.avg_activation for t in run.history] == pytest.approx([t.avg_activation for t in plain.history], abs=1e-12)
    assert not folded if extra is Falls else max(folded) < 90  # Falls goes by ids
