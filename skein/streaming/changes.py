"""Change streams: suppression of equal snapshots, latest value by key, sessions, watch loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import ship

MESSAGE = "struct<type:string,workspace:string,payload:string>"


class _Changed(StatefulProcessor):
    """Keeps each key's last fingerprint; rows that repeat it are dropped."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "fingerprint string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        of_key = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable", ignore_index=True)
        prints = of_key["fingerprint"].astype(object)
        before = prints.shift(1)
        before.iloc[0] = self.last.get()[0] if self.last.exists() else None
        self.last.update((prints.iloc[-1],))
        same = (prints == before) | (prints.isna() & before.isna())
        kept = of_key[~same.to_numpy()]
        yield pd.DataFrame({"key": key[0], "ts": kept["ts"], "fingerprint": kept["fingerprint"]})

    def close(self) -> None:
        pass


def only_changes(stream: DataFrame) -> DataFrame:
    """key, ts, fingerprint of the rows whose fingerprint differs from their key's last; needs the RocksDB state store."""
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.select("key", "ts", "fingerprint").groupBy("key").transformWithStateInPandas(_Changed(), "key string, ts timestamp, fingerprint string", "Append", "None")


def only_changes_batch(rows: DataFrame) -> DataFrame:
    """The same over a finished table."""
    from pyspark.sql import Window

    before = F.lag("fingerprint").over(Window.partitionBy("key").orderBy("ts"))
    return rows.withColumn("b", before).where(~F.col("fingerprint").eqNullSafe(F.col("b"))).drop("b")


def events_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet") -> DataFrame:
    """Files that arrive in a folder, with an event time that watermarks accept."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def latest(stream: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """The last value of each key: a registry fed by registrations."""
    return stream.groupBy(key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))


def sessions(stream: DataFrame, gap: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Runs of a user's events without a pause longer than ``gap``: a heartbeat's life."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event type and time window, late events beyond the watermark left out (an extension)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def message(kind: str, workspace: Column, payload: Column) -> Column:
    """GitChanges, GraphUpdated, Error or Pong as one column."""
    return F.struct(F.lit(kind).alias("type"), workspace.alias("workspace"), payload.alias("payload"))


class Poller:
    """A rate-limited read: within ``every`` seconds the last value is given again."""

    def __init__(self, read: Callable[[], object], every: float = 0.5, clock: Callable[[], float] | None = None):
        import time

        self.read, self.every, self.clock = read, every, clock or time.monotonic
        self.at, self.value = None, None

    def should_poll(self) -> bool:
        return self.at is None or self.clock() - self.at >= self.every

    def poll(self):
        return self.force_poll() if self.should_poll() else self.value

    def force_poll(self):
        self.at, self.value = self.clock(), self.read()
        return self.value

    def cached(self):
        return self.value


def should_restart(policy, code_changed, exit_code):
    """Whether a process restarts, by policy: never, on_code_change, on_crash or always."""
    crash = F.coalesce(exit_code != 0, F.lit(False))
    return F.when(policy == "always", code_changed | exit_code.isNotNull()).when(policy == "on_code_change", code_changed).when(policy == "on_crash", crash).otherwise(False)


#: Process events: start, exit (with a code), kill, change (of the code).
def process_states(events: DataFrame) -> DataFrame:
    """process, seq, running, restarts and restarted after each event (process, seq, event, exit_code, policy).

    A start runs a process and a kill ends it; an exit or a change restarts it as its policy says, and an exit that doesn't
    ends it; a change that doesn't leaves it. Events of a process that doesn't run, but a start, leave it. The state follows
    from the last event that set it: windows over a process's events, no fold in Python.
    """
    from pyspark.sql import Window

    so_far = Window.partitionBy("process").orderBy("seq")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    again = should_restart(F.col("policy"), F.col("event") == "change", F.when(F.col("event") == "exit", F.col("exit_code")))
    again = F.col("event").isin("exit", "change") & F.coalesce(again, F.lit(False))
    sets = F.when(F.col("event") == "start", True).when(F.col("event") == "kill", False).when((F.col("event") == "exit") & ~again, False)
    marked = events.withColumn("__again", again).withColumn("__sets", sets)
    was = F.coalesce(F.last("__sets", ignorenulls=True).over(before), F.lit(False))
    marked = marked.withColumn("restarted", F.col("__again") & was).withColumn("running", F.coalesce(F.last("__sets", ignorenulls=True).over(so_far), F.lit(False)))
    return marked.withColumn("restarts", F.count_if(F.col("restarted")).over(so_far)).select("process", "seq", "running", "restarted", "restarts")


class Broadcast:
    """One sender, many clients, at most once: a client that lags by more than ``capacity`` loses the oldest, and is told how many."""

    def __init__(self, capacity: int = 256):
        from collections import deque

        self.capacity, self.make, self.queues, self.lost = capacity, deque, {}, {}

    def subscribe(self, client: str) -> None:
        self.queues[client], self.lost[client] = self.make(), 0

    def unsubscribe(self, client: str) -> None:
        self.queues.pop(client, None)
        self.lost.pop(client, None)

    def send(self, text: str) -> int:
        """To all clients; how many there are."""
        for client, queue in self.queues.items():
            queue.append(text)
            if len(queue) > self.capacity:
                queue.popleft()
                self.lost[client] += 1
        return len(self.queues)

    def receive(self, client: str) -> list[str]:
        """What waits for a client, after a warning if some was lost."""
        queue, n = self.queues[client], self.lost[client]
        out = ([f"lagged: {n} lost"] if n else []) + list(queue)
        queue.clear()
        self.lost[client] = 0
        return out

    def batch(self, rows: DataFrame, _number: int = 0) -> None:
        """For foreachBatch: the text column of a micro-batch, streamed row by row."""
        for r in rows.select("text").toLocalIterator():
            self.send(r["text"])


def heartbeat(beat: Callable[[], bool], cancelled: Callable[[], bool], wait: Callable[[float], None], every: float = 5.0) -> tuple[int, int]:
    """Beats every ``every`` seconds until cancelled; a failed beat is tried again like any other: (beats, failures)."""
    beats = failures = 0
    while not cancelled():
        try:
            ok = beat()
        except OSError:
            ok = False
        beats, failures = beats + bool(ok), failures + (not ok)
        wait(every)
    return beats, failures


def changed_paths(changes: DataFrame) -> DataFrame:
    """path, distinct."""
    return changes.select("path").distinct()


def change_of(changes: DataFrame, path: str) -> DataFrame:
    return changes.where(F.col("path") == path)


def is_stale(captured: Column, now: Column, seconds: float) -> Column:
    """Whether a snapshot is older than that many seconds."""
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(captured.cast("timestamp")) > int(seconds * 1_000_000)


def evolved(transitions: DataFrame) -> DataFrame:
    """id of what has had a transition after its first; transitions: id, a row each."""
    return transitions.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")


def ring(rows: DataFrame, order: str, most: int = 200) -> DataFrame:
    """The last ``most`` rows."""
    return rows.orderBy(F.desc(order)).limit(most)


def playback(snapshots: list[int], seconds: float, speed: float) -> int:
    """The place, in a list of frames, that a replay shows after some seconds; it wraps."""
    return int(seconds * speed) % len(snapshots) if snapshots else 0


def percentiles(samples: DataFrame, last: int = 120) -> DataFrame:
    """One row over the newest samples (pos, ms): avg_fps, p50, p95, p99, max; at place floor(n * p)."""
    top = samples.orderBy(F.desc("pos")).limit(last)
    a = top.agg(F.sort_array(F.collect_list("ms")).alias("v"), F.avg("ms").alias("avg"))
    at = lambda p: F.get("v", F.least(F.floor(F.size("v") * p), F.size("v") - 1).cast("int"))
    return a.select((1000 / F.col("avg")).alias("avg_fps"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.array_max("v").alias("max"))


