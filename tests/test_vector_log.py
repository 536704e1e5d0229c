"""The log of vectors against a dict."""

import random

import pytest

from skein.operators import vectors as V
from skein.sources.vector_log import Conflict, VectorLog


@pytest.mark.parametrize("seed", [1, 2])
def test_log_equals_a_dict(spark, tmp_path, seed):
    draw, log, want = random.Random(seed), VectorLog(spark, str(tmp_path / "log")), {}
    for _ in range(14):
        ids = [draw.randrange(12) for _ in range(draw.randrange(1, 9))]
        act = draw.choice(["upsert", "upsert", "remove", "compact"])
        if act == "upsert":
            rows = [(i, k, [float(draw.randrange(100))]) for k, i in enumerate(ids)]
            want |= {i: v for i, _, v in rows}
            draw.shuffle(rows)
            log.upsert(spark.createDataFrame(rows, "id long, seq long, embedding array<float>").repartition(3))
        elif act == "remove":
            log.remove(spark.createDataFrame([(i,) for i in ids], "id long"))
            want = {i: v for i, v in want.items() if i not in ids}
        else:
            log.compact(fan=2)
        assert {r.id: r.embedding for r in log.read().collect()} == want
    log.compact(fan=2)
    assert all(n < 2 for n in log.levels().values()) and {r.id: r.embedding for r in log.read().collect()} == want


def test_log_bears_odd_rows_and_writers(spark, tmp_path):
    log = VectorLog(spark, str(tmp_path / "log"))
    assert not log.exists() and log.read().count() == 0 and log.compact() == 0
    log.remove(spark.createDataFrame([(1,)], "id long"))
    log.upsert(spark.createDataFrame([(1, None), (None, [1.0]), (2, [])], "id long, embedding array<float>"))
    assert sorted(((r.id, r.embedding) for r in log.read().collect()), key=str) == [(1, None), (2, []), (None, [1.0])]
    number, manifest = log._manifest()
    log.remove(spark.createDataFrame([(2,)], "id long"))
    with pytest.raises(Conflict):  # a writer that read the manifest before the removal
        log._commit(number + 1, manifest)
    assert log.read().count() == 2
    log.replace(spark.createDataFrame([(7, [1.0])], "id long, embedding array<float>"))
    assert [r.id for r in log.read().collect()] == [7]


def test_removals_last_until_nothing_older_is_left(spark, tmp_path):
    log, one = VectorLog(spark, str(tmp_path / "log")), spark.createDataFrame([(1, [1.0])], "id long, embedding array<float>")
    for _ in range(2):
        log.upsert(one)
    assert log.compact(fan=2) == 1 and log.levels() == {1: 1}
    log.remove(one)
    log.upsert(spark.createDataFrame([(2, [2.0])], "id long, embedding array<float>"))
    assert log.compact(fan=2) == 2 and log.levels() == {2: 1} and [r.id for r in log.read().collect()] == [2]


def test_upserts_keep_the_last(spark):
    index = spark.createDataFrame([(1, [0.0]), (2, [5.0])], "id long, embedding array<float>")
    rows = spark.createDataFrame([(1, k, [float(k)]) for k in range(8)], "id long, seq long, embedding array<float>").repartition(4)
    assert {r.id: r.embedding for r in V.upsert(index, rows).collect()} == {1: [7.0], 2: [5.0]}
