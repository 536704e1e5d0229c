"""Neighbours of all vectors against brute force."""

import numpy as np
import pytest

from skein.operators import neighbours as N


def plain(rows, k, least):
    fine = {i: np.asarray(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = set()
    for i, v in fine.items():
        scores = [(-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 12), j) for j, w in fine.items() if j != i and len(w) == len(v)]
        out |= {(i, j) for s, j in sorted(x for x in scores if -x[0] > least)[:k]}
    return out


def found(spark, rows, k=5, least=0.1):
    df = spark.createDataFrame(rows, "id long, embedding array<double>").selectExpr("*", "'x' AS cell", "1 AS score")
    got = [(r.id, r.peer) for r in N.all_neighbours(df, k, least).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("shape", ["spread", "clouds", "copies", "plane"])
def test_neighbours_equal_brute_force(spark, shape, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 40)
    draw = np.random.default_rng(7)
    n = 260
    vectors = {"spread": draw.normal(size=(n, 12)), "clouds": draw.normal(size=(9, 12))[draw.integers(0, 9, n)] + draw.normal(size=(n, 12)) * 0.05, "copies": draw.integers(-1, 2, size=(n, 3)).astype(float), "plane": draw.normal(size=(n, 2))}[shape]
    if shape == "copies":
        vectors[::3] = [1.0, 1.0, 1.0]  # a third is one vector
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(draw.permutation(n), vectors)]
    assert found(spark, rows) == plain(rows, 5, 0.1)
    assert found(spark, rows, 2, 0.7) == plain(rows, 2, 0.7)


def test_neighbours_of_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0])]
    assert found(spark, rows) == {(6, 7), (7, 6)} == plain(rows, 5, 0.1)
    assert found(spark, rows[:3]) == set() == found(spark, [])


def test_few_cells_are_asked_where_vectors_lie_in_clouds(spark, monkeypatch):
    """Bounds keep the second round small: far fewer rows than vectors times cells."""
    monkeypatch.setattr(N, "PIECE", 25)
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(20, 16))[draw.integers(0, 20, 600)] + draw.normal(size=(600, 16)) * 0.01
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    sent = spark.sparkContext.accumulator(0)
    best = N._best

    def counted(asking, members, *rest):
        sent.add(len(asking))
        return best(asking, members, *rest)

    try:
        N._best = counted
        assert found(spark, rows) == plain(rows, 5, 0.1)
    finally:
        N._best = best
    assert sent.value < 600 * 24 / 4


def test_pieces_grow_with_the_table():
    """Vectors are sent to no more than 32 cells while pieces may grow, which they do to eight times."""
    assert N.piece_of(1) == N.piece_of(32 * 4096) == 4096
    assert all(-(-n // N.piece_of(n)) <= 32 for n in (150_000, 400_000, 32 * 8 * 4096))
    assert N.piece_of(10**8) == 8 * 4096
