"""The watch loop: changes of fingerprints, what they impact, what to do first, and a snapshot, for each micro-batch once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import Graph
from ..operators import traversal
from ..operators.tables import cut, free
from .changes import only_changes


@dataclass
class WatchLoop:
    """Follows a stream of (key, ts, fingerprint), keys being ids of nodes, and keeps tables below ``folder``.

    changes: id, ts, fingerprint of each change; impact: id and depth of the nodes that depend on a changed one within ``depth``
    steps; tasks: the first ``tasks`` of these to look at, most depended on first; all with the batch's number.

    A batch's tables are written to folders of its own, replacing what an attempt before may have left, and the ledger gets its
    entry last. A batch in the ledger is left alone when the stream is restarted and plays it again; readers see the ledger's
    batches only. So each batch counts once, whenever the loop was killed.
    """

    graph: Graph
    folder: str
    name: str = "watch"
    depth: int = 2
    tasks: int = 10

    def __post_init__(self):
        self.spark: SparkSession = self.graph.nodes.sparkSession
        self._path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entry(self, batch: int):
        return self._path(f"{self.folder}/ledger/{self.name}/{batch}")

    def done(self) -> list[int]:
        """The batches in the ledger."""
        top = self._path(f"{self.folder}/ledger/{self.name}")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def _at(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/{self.name}/batch={batch}"

    def _write(self, table: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._at(table, batch))

    def on_batch(self, rows: DataFrame, batch: int) -> None:
        """For foreachBatch; rows: key, ts, fingerprint of what changed."""
        if self._fs.exists(self._entry(batch)):
            return
        self._write("changes", batch, rows.select(F.col("key").cast("long").alias("id"), "ts", "fingerprint"))
        changed = self.spark.read.parquet(self._at("changes", batch))
        found = traversal.impact(self.graph, changed.select("id").distinct(), self.depth)
        impact = cut(found.select("id", "depth", "in_degree", "pos"))
        self._write("impact", batch, impact.select("id", "depth"))
        self._write("tasks", batch, impact.orderBy(F.desc("in_degree"), "pos").limit(self.tasks).select("id", "in_degree"))
        free(impact)
        self._fs.create(self._entry(batch), False).close()

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """The running query; with the same checkpoint it goes on where it was stopped. trigger as in writeStream."""
        writer = only_changes(stream).writeStream.outputMode("append").foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "2 seconds"})).start()

    def read(self, table: str) -> DataFrame | None:
        """changes, impact or tasks of all batches in the ledger; None before the first."""
        paths = [self._at(table, b) for b in self.done()]
        return self.spark.read.option("basePath", f"{self.folder}/{table}/{self.name}").parquet(*paths) if paths else None
