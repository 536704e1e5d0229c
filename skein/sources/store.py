"""Stores: graphs, states, descriptions, histories, vectors and snapshots as Parquet under one folder; graphs as JSON too.

Snapshots are partitions of one table by their time, so keeping the newest k deletes folders and rewrites nothing.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from .vector_log import VectorLog


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self._at(name)))

    def save(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._at(name))

    def load(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(self._at(name)) if self.exists(name) else None

    def read_through(self, name: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        """What is stored, else what ``make`` gives, stored first."""
        if force or not self.exists(name):
            self.save(name, make())
        return self.load(name)

    def save_project(self, sources: DataFrame) -> None:
        """Sources without their content."""
        self.save("project", sources.drop("content"))

    def save_graph(self, g: Graph) -> None:
        self.save("graph/nodes", g.nodes)
        self.save("graph/edges", g.edges)

    def load_graph(self) -> Graph | None:
        nodes, edges = self.load("graph/nodes"), self.load("graph/edges")
        return Graph(nodes, edges) if nodes is not None and edges is not None else None

    def save_json(self, name: str, value: dict) -> None:
        self.spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(self._at(name))

    def load_json(self, name: str) -> dict | None:
        return json.loads(self.spark.read.text(self._at(name)).first()[0]) if self.exists(name) else None

    def vectors(self) -> VectorLog:
        """The log behind the stored index, for upserts, removals and compaction."""
        return VectorLog(self.spark, self._at("vectors/log"))

    def save_vectors(self, index: DataFrame, model: str, dim: int, extra: dict | None = None) -> None:
        self.vectors().replace(index)
        self.save_json("vectors/meta", {"model": model, "dim": dim, **(extra or {})})

    def load_vectors(self) -> tuple[DataFrame, dict] | None:
        """The index and what describes it; none if either is missing."""
        log, meta = self.vectors(), self.load_json("vectors/meta")
        return (log.read(), meta) if meta is not None and log.exists() else None

    def snapshot(self, name: str, df: DataFrame, at_ms: int | None = None) -> int:
        at = int(time.time() * 1000) if at_ms is None else at_ms
        df.write.mode("overwrite").parquet(self._at(f"{name}/snapshot_ms={at}"))
        return at

    def snapshots(self, name: str) -> list[int]:
        """Times, newest first."""
        if not self.exists(name):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self._at(name)))]
        return sorted((int(n.split("=")[1]) for n in found if n.startswith("snapshot_ms=") and n.split("=")[1].isdigit()), reverse=True)

    def load_snapshot(self, name: str, at_ms: int | None = None) -> DataFrame | None:
        """The snapshot of a time, else the newest; None if there is none."""
        have = self.snapshots(name)
        at = at_ms if at_ms is not None else have[0] if have else None
        return self.spark.read.parquet(self._at(f"{name}/snapshot_ms={at}")) if at in have else None

    def prune(self, name: str, keep: int) -> int:
        gone = self.snapshots(name)[keep:]
        for at in gone:
            self._fs.delete(self._path(self._at(f"{name}/snapshot_ms={at}")), True)
        return len(gone)

    def clean(self, name: str = "") -> None:
        self._fs.delete(self._path(self._at(name) if name else self.folder), True)

    def append_event(self, kind: str, payload: dict) -> None:
        row = self.spark.createDataFrame([(kind, json.dumps(payload, sort_keys=True), time.time_ns())], "type string, payload string, seq long")
        row.coalesce(1).write.mode("append").parquet(self._at("events"))

    def events(self) -> DataFrame | None:
        e = self.load("events")
        return e.orderBy("seq") if e is not None else None

    def stats(self) -> dict:
        """Bytes, files and snapshots by name below the folder."""
        if not self.exists(""):
            return {"bytes": 0, "files": 0}
        s = self._fs.getContentSummary(self._path(self.folder))
        return {"bytes": s.getLength(), "files": s.getFileCount()}


GRAPH_JSON = "nodes array<struct<id:bigint,name:string,kind:string,metadata:map<string,string>>>, edges array<struct<id:bigint,from:bigint,to:bigint,relationship:string,metadata:map<string,string>>>, metadata map<string,string>"


#: How a document begins that ``write_graph_json`` made: an element a line, so that it can be split anywhere.
BEGINS, BETWEEN, ENDS = '{"nodes":[', '],"edges":[', '],"metadata":{}}'


def read_graph_json(spark: SparkSession, path: str) -> Graph:
    """A graph document; list places become pos, path and language come from metadata.

    A document with an element a line is split by byte ranges; in one of any other layout one task reads it.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs, lines = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), False
    if fs.getFileStatus(at).isFile():
        stream = fs.open(at)
        lines = all(stream.read() == ord(c) for c in BEGINS + "\n")
        stream.close()
    if lines:
        n, e = _split_document(spark, path)
    else:
        doc = spark.read.schema(GRAPH_JSON).option("multiLine", True).json(path)
        n = doc.select(F.posexplode("nodes").alias("pos", "n")).select("pos", "n.*")
        e = doc.select(F.posexplode("edges").alias("pos", "e")).select("pos", "e.*")
    nodes = n.select("id", F.col("pos").cast("long").alias("pos"), "name", "kind", F.coalesce(F.col("metadata")["path"], F.col("metadata")["relative_path"], "name").alias("path"), "metadata")
    return Graph(nodes, e.select(F.col("from").alias("src"), F.col("to").alias("dst"), "relationship", F.col("pos").cast("long").alias("pos")))


def _split_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a document with an element a line; pos grows as the document goes on.

    A line's place is where its split begins plus its number in its task: no task has as many lines as a split has bytes.
    """
    inner = re.fullmatch(r"nodes array<(.*?)>, edges array<(.*?)>, metadata map<string,string>", GRAPH_JSON)
    rows = spark.read.text(path).select("value", (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("pos"))
    rows = rows.where(~F.col("value").isin(BEGINS, BETWEEN, ENDS)).withColumn("value", F.regexp_replace("value", "^[, ]", ""))
    is_edge = F.get_json_object("value", "$.from").isNotNull()
    read = lambda part, schema: part.select("pos", F.from_json("value", schema).alias("x")).select("pos", "x.*")
    return read(rows.where(~is_edge), inner[1]), read(rows.where(is_edge), inner[2])


def write_graph_json(g: Graph, path: str) -> None:
    """One document, in the order of pos, an element a line, in place of what was there.

    Tasks write its pieces, by ranges of pos; a commit then strings the pieces together, by the file system's own concatenation
    of files where it has one, else by copying bytes a buffer at a time. No task or object holds the document.
    """
    spark, pieces = g.nodes.sparkSession, f"{path}_pieces"
    node = F.struct("id", "name", "kind", F.create_map(F.lit("path"), F.col("path")).alias("metadata"))
    edge = F.struct(F.col("pos").alias("id"), F.col("src").alias("from"), F.col("dst").alias("to"), "relationship")
    # All elements but the first of their list begin with a comma.
    start = F.when(F.monotonically_increasing_id() == 0, " ").otherwise(",")
    for name, rows, element, order in (("nodes", g.nodes, node, ["pos", "id"]), ("edges", g.edges, edge, ["pos", "src", "dst"])):
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        placed.select(F.concat(start, F.to_json(element)).alias("value")).write.mode("overwrite").text(f"{pieces}/{name}")
    _concatenated(spark, pieces, path)


def _concatenated(spark: SparkSession, pieces: str, path: str) -> None:
    """The pieces below a folder, by name, between the lines that make them a document; the pieces go."""
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    target = at(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def line(name: str, text: str):
        out = fs.create(at(f"{pieces}/{name}"), True)
        out.write(bytearray((text + "\n").encode()))
        out.close()
        return at(f"{pieces}/{name}")

    parts = lambda name: sorted((s.getPath() for s in fs.listStatus(at(f"{pieces}/{name}")) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p.getName())
    files = [line("begins", BEGINS), *parts("nodes"), line("between", BETWEEN), *parts("edges"), line("ends", ENDS)]
    fs.delete(target, True)
    if fs.getUri().getScheme() == "hdfs":
        fs.rename(files[0], target)
        rest = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(files) - 1)
        for k, f in enumerate(files[1:]):
            rest[k] = f
        fs.concat(target, rest)
    else:
        out = fs.create(target, True)
        for f in files:
            source = fs.open(f)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 4 << 20, False)
            source.close()
        out.close()
    fs.delete(at(pieces), True)
