"""What goes another way over graphs that are written already gives the same."""

import random

from skein.graph import Graph
from skein.operators import degrees as D


def test_sums_over_cut_edges_equal_those_over_others(spark):
    """Loops, parallel edges, ties of pos, negative and very large pos, nodes without edges; pairs without a sort."""
    draw = random.Random(5)
    for wide in (1, 1 << 60):
        rows = [(draw.randrange(12), draw.randrange(12), draw.choice(["uses", "imports", "contains", "É"]), draw.randrange(-2, 3) * wide) for _ in range(300)]
        g = Graph(spark.range(15).selectExpr("id", "id AS pos"), spark.createDataFrame(rows, "src long, dst long, relationship string, pos long"))
        own = g.cut()
        for made in (Graph.pairs, D.degrees, D.normalised, lambda x: D.normalised(x, ("uses",), 1)):
            assert sorted(map(tuple, made(own).collect())) == sorted(map(tuple, made(g).collect()))
        plan = own.pairs()._jdf.queryExecution().executedPlan().toString()
        assert ("SortAggregate" in plan) == (wide > 1)
