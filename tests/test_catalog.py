"""Every graph query against its SQL twin, or at least run where SQL has no twin."""

import math
import os

import duckdb
import pytest

from skein.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return None if math.isnan(f) else f"{f:.9g}" if isinstance(v, float) and f != int(f) else str(int(f)) if f == int(f) else f"{f:.9g}"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    if name in ORACLES:
        cursor = con.execute(ORACLES[name])
        have = [x[0] for x in cursor.description]
        assert sorted(have) == columns
        order = [have.index(c) for c in columns]
        assert rows == sorted((tuple(plain(r[k]) for k in order) for r in cursor.fetchall()), key=str)


def test_entry(spark, sf):
    assert catalog.entry(spark, sf).count() == 20


def test_entry_module_has_all_queries():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_lines_are_dealt_once_for_both_distincts(spark, monkeypatch):
    """Into parts by their number, which no step coalesces or deals anew; the edges stay the same."""
    from skein import graph
    from skein.plans.projections import fk_graph

    where = "/root/testdata/sf0.001"
    want = sorted(map(tuple, fk_graph(spark, where).edges.collect()))
    monkeypatch.setattr(graph, "PART", 500)
    edges = fk_graph(spark, where).edges
    assert sorted(map(tuple, edges.collect())) == want
    plan = edges._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("hashpartitioning") == 2 == plan.count("REPARTITION_BY_NUM")
