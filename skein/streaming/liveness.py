"""Liveness and registration of keys over a stream: state that ends with the key it belongs to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import ship

LIVES = "key string, since long, last long, until long, beats long"
NAMES = "key string, at long, value string, live boolean"


def _rocks(stream: DataFrame) -> None:
    ship(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True)


class _Lives(StatefulProcessor):
    """A key's first and last beat of its present life and how many there were; a timer ends it."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "since long, last long, beats long")

    def _wake(self, last: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(-(-(last + self.gap) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = np.sort(np.concatenate([r["us"].to_numpy("int64") for r in rows]))
        before = self.life.get() if self.life.exists() else None
        at = np.maximum(at, before[1]) if before else at
        # Beats whose predecessor is too long ago begin a life; all lives but the last are over.
        begins = np.flatnonzero(np.diff(at, prepend=before[1] if before else at[0] - self.gap) >= self.gap)
        first = np.concatenate([[0] if before else [], begins]).astype(int)
        if before and len(begins) and begins[0] == 0:
            first = first[1:]
            yield self._row(key, before[0], before[1], before[2])
            before = None
        ends = np.append(first[1:], len(at))
        since, beats = at[first], ends - first
        if before:
            since[0], beats[0] = before[0], beats[0] + before[2]
        over = [self._row(key, s, at[e - 1], n) for s, e, n in zip(since[:-1], ends[:-1], beats[:-1])]
        self.life.update((int(since[-1]), int(at[-1]), int(beats[-1])))
        self._wake(int(at[-1]))
        yield pd.concat(over) if over else self._row(key, 0, 0, 0)[:0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.life.exists():
            since, last, beats = self.life.get()
            self.life.clear()
            yield self._row(key, since, last, beats)

    def _row(self, key, since, last, beats) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "since": [int(since)], "last": [int(last)], "until": [int(last) + self.gap], "beats": [int(beats)]})

    def close(self) -> None:
        pass


def _times(df: DataFrame) -> DataFrame:
    at = lambda c: F.timestamp_micros(F.col(c)).alias(c)
    return df.select("key", at("since"), at("last"), at("until"), "beats")


def disconnects(stream: DataFrame, gap_seconds: float = 30, late: str = "1 minute") -> DataFrame:
    """A row (key, since, last, until, beats) for each key that fell silent for ``gap_seconds``: of its beats (key, ts) the first
    and last, and when it counted as gone. Beats that come later than ``late`` are left out.

    A key holds one row of state while it lives and a timer at its end; both go with the disconnect, so that the state is as
    large as the number of keys alive.
    """
    _rocks(stream)
    beats = stream.withWatermark("ts", late).select(F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("us")).where("key IS NOT NULL AND ts IS NOT NULL")
    return _times(beats.groupBy("key").transformWithStateInPandas(_Lives(int(gap_seconds * 1e6)), LIVES, "Append", "EventTime"))


def disconnects_batch(beats: DataFrame, gap_seconds: float = 30, late_seconds: float = 60) -> DataFrame:
    """The same over a finished table: lives that were over by its last time less what may come late."""
    gap = int(gap_seconds * 1e6)
    own = Window.partitionBy("key").orderBy("us")
    rows = beats.where("key IS NOT NULL AND ts IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = rows.withColumn("life", F.sum(F.when(F.col("us") - F.lag("us").over(own) < gap, 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    lives = rows.groupBy("key", "life").agg(F.min("us").alias("since"), F.max("us").alias("last"), F.count(F.lit(1)).alias("beats")).withColumn("until", F.col("last") + gap)
    # A watermark counts in whole milliseconds; a life is over by a later beat of its key or by the watermark.
    passed = F.broadcast(rows.agg((F.floor(F.max("us") / 1000) * 1000 - int(late_seconds * 1e6)).alias("passed")))
    followed = F.lead("since").over(Window.partitionBy("key").orderBy("since")).isNotNull()
    return _times(lives.withColumn("followed", followed).join(passed).where(F.col("followed") | (F.col("until") <= F.col("passed"))))


class _Names(StatefulProcessor):
    """A key's newest entry; a removal stays as a tombstone for a while, so that an older entry coming late is not taken for new."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at long, value string, live boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = max(((int(r.us), bool(r.live), r.value) for part in rows for r in part.nlargest(1, "us", keep="all").itertuples()), key=lambda x: (x[0], x[1], x[2] or ""))
        old = self.entry.get() if self.entry.exists() else None
        if old and (old[0], old[2], old[1] or "") >= (new[0], new[1], new[2] or ""):
            return
        self.entry.update((new[0], new[2], new[1]))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if not new[1]:
            self.handle.registerTimer(-(-(new[0] + self.keep) // 1000))
        yield pd.DataFrame({"key": [key[0]], "at": [new[0]], "value": [new[2]], "live": [new[1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def registry(stream: DataFrame, keep_seconds: float = 60, late: str = "1 minute") -> DataFrame:
    """Changes (key, at, value, live) of a registry fed by entries (key, ts, value, live): the newest of each key in a micro-batch,
    if it is newer than what is known. An entry that isn't live unregisters its key; that is remembered for ``keep_seconds``, at
    least as long as entries may be late, and then the key's state goes. Entries of one time: the live one, then by value.
    """
    _rocks(stream)
    rows = stream.withWatermark("ts", late).select(F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("us"), "value", F.coalesce("live", F.lit(True)).alias("live"))
    out = rows.where("key IS NOT NULL AND ts IS NOT NULL").groupBy("key").transformWithStateInPandas(_Names(int(keep_seconds * 1e6)), NAMES, "Append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("at"))


def names(changes: DataFrame) -> DataFrame:
    """key, value of what is registered after some changes."""
    last = changes.groupBy("key").agg(F.max(F.struct("at", "live", F.coalesce("value", F.lit("")).alias("order"), "value")).alias("last"))
    return last.where("last.live").select("key", "last.value")
