"""Streams that are killed, restarted, late or silent."""

import datetime as dt
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from skein.operators import traversal as T
from skein.streaming import changes as C
from skein.streaming import liveness
from skein.streaming.loop import WatchLoop

START = dt.datetime(2024, 1, 1)
ROW = "key string, ts timestamp, fingerprint string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_a_replayed_batch_counts_once(spark, tmp_path):
    """The loop dies after its tables are written and before the ledger has the batch; the restart plays it again."""
    g = T.sample_graph(spark)
    files, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    for k, rows in enumerate([[("2", at(0), "a"), ("2", at(1), "a")], [("2", at(2), "b"), ("1", at(3), "x")], [("2", at(4), "b"), ("1", at(5), "y")]]):
        spark.createDataFrame(rows, ROW).coalesce(1).write.parquet(f"{files}/{k}")
    stream = lambda: spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{files}/*")

    class Dying(WatchLoop):
        def _write(self, table, batch, rows):
            super()._write(table, batch, rows)
            if table == "tasks" and batch == 1:
                raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        Dying(g, str(tmp_path / "out")).start(stream(), checkpoint, availableNow=True).awaitTermination()
    loop = WatchLoop(g, str(tmp_path / "out"))
    assert loop.done() == [0] and loop.read("changes").count() == 1
    loop.start(stream(), checkpoint, availableNow=True).awaitTermination()
    assert loop.done()[:3] == [0, 1, 2]
    assert sorted((r.id, r.fingerprint) for r in loop.read("changes").collect()) == [(1, "x"), (1, "y"), (2, "a"), (2, "b")]
    assert sorted((r.id, r.depth, r.batch) for r in loop.read("impact").where("batch < 3").collect()) == [(1, 1, 0), (3, 1, 0), (3, 1, 1)]
    before = [(r.id, r.batch) for r in loop.read("tasks").collect()]
    loop.on_batch(spark.createDataFrame([("3", at(9), "z")], ROW), 1)  # in the ledger: nothing happens
    assert [(r.id, r.batch) for r in loop.read("tasks").collect()] == before


def beats_as_files(spark, folder, seed):
    draw, rows, now = random.Random(seed), [], 0
    for _ in range(6):
        part = []
        for _ in range(60):
            now += draw.choice([0, 1, 2, 9])
            part.append((draw.choice("abcdefgh") if now < 700 else draw.choice("ab"), at(now)))
        rows += part
        draw.shuffle(part)
        spark.createDataFrame(part, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_disconnects_equal_the_batch_and_state_goes(spark, tmp_path, seed):
    rows = beats_as_files(spark, str(tmp_path / "in"), seed)
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = liveness.disconnects(stream, 30, "1 second").writeStream.format("memory").queryName(f"gone{seed}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = liveness.disconnects_batch(spark.createDataFrame(rows, "key string, ts timestamp"), 30, 1)
    assert sorted(map(tuple, spark.table(f"gone{seed}").collect())) == sorted(map(tuple, want.collect()))
    over = {(r.key, r.until) for r in want.collect()}
    alive = {k for k, t in rows if not any(k == o and u > t for o, u in over)}
    # A row of state for each key alive, besides its timer, which two column families hold.
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) <= 3 * len(alive) < 3 * len({k for k, _ in rows})


def test_registry_forgets_who_left(spark, tmp_path):
    entries = [[("a", at(0), "1", True), ("b", at(1), "2", True)], [("a", at(10), None, False), ("b", at(11), "3", True)], [("a", at(5), "old", True), ("c", at(12), "4", None)], [("c", at(400), "5", True)], [("c", at(401), "6", True)]]
    for k, rows in enumerate(entries):
        spark.createDataFrame(rows, "key string, ts timestamp, value string, live boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("key string, ts timestamp, value string, live boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = liveness.registry(stream, 60, "1 minute").writeStream.format("memory").queryName("named").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    changes = spark.table("named")
    assert sorted((r.key, r.value) for r in liveness.names(changes).collect()) == [("b", "3"), ("c", "6")]
    assert changes.where("value = 'old'").count() == 0
    assert sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]) <= 2 * 3


def test_only_changes_keeps_a_boundary(spark, tmp_path):
    rows = [("k", at(t), f) for t, f in enumerate(["a", "a", None, None, "b", "b", "a"])] + [("l", at(0), None)]
    for k, part in enumerate([rows[:2], rows[2:5], rows[5:]]):
        spark.createDataFrame(part, ROW).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    C.only_changes(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.key, r.ts.second, r.fingerprint or "-") for r in spark.table("kept").collect()) == [("k", 0, "a"), ("k", 2, "-"), ("k", 4, "b"), ("k", 6, "a")]


@pytest.mark.parametrize("name", ["n1_stream_of_changes", "n7_disconnects", "n8_registry"])
def test_what_a_stream_gave_lies_in_files(spark, sf, name):
    """Not in the driver's memory, which a memory sink fills with every row."""
    from skein.plans import catalog

    frame = catalog.queries()[name](spark, sf)
    assert frame.inputFiles() and frame.count()
