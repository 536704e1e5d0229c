"""A log-structured store of vectors: changes are appended as segments, merged when read, and compacted level by level.

A segment is a Parquet folder of (id, at, seq, gone, embedding): ``at`` counts the changes made to the store, ``seq`` orders the rows
of one change, ``gone`` marks a removal. Of each id the row of the largest (at, seq) counts. A manifest names the segments that are
live; a change writes its segment first and then the next manifest, which only one writer can create, so a reader sees all of a
change or nothing, and a writer that was killed leaves nothing but an unnamed folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments of a level that are merged into one of the next.
FAN = 4

SEGMENT = "id long, at long, seq long, gone boolean, embedding array<float>"


class Conflict(RuntimeError):
    """Another writer made the next manifest first; nothing of this change is visible, and it may be tried again."""


class VectorLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict]:
        """The newest manifest's number and content; 0 and an empty one if there is none."""
        top = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(top):
            return 0, {"at": 0, "segments": []}
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        last = max((int(n) for n in names if n.isdigit()), default=0)
        if not last:
            return 0, {"at": 0, "segments": []}
        return last, json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/manifests/{last:012d}").collect()))

    def _commit(self, number: int, content: dict) -> None:
        """Makes the next manifest; a file that is there already was another writer's."""
        to = self._path(f"{self.folder}/manifests/{number:012d}")
        made = self._path(f"{self.folder}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(made, to):
            self._fs.delete(made, False)
            raise Conflict(f"manifest {number} exists")

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/segments/{name}")
        return name

    def _append(self, rows: DataFrame) -> int:
        """Rows (id, seq, gone, embedding) as the next change; its number."""
        number, manifest = self._manifest()
        at = manifest["at"] + 1
        name = self._write(rows.select("id", F.lit(at).cast("long").alias("at"), "seq", "gone", F.col("embedding").cast("array<float>").alias("embedding")))
        self._commit(number + 1, {"at": at, "segments": [*manifest["segments"], {"name": name, "level": 0, "at": at}]})
        return at

    def exists(self) -> bool:
        return self._manifest()[0] > 0

    def upsert(self, rows: DataFrame) -> int:
        """Rows (id, embedding and, if an id may come more than once, seq); the row of the largest seq counts."""
        seq = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(0).cast("long")
        return self._append(rows.select("id", seq.alias("seq"), F.lit(False).alias("gone"), "embedding"))

    def remove(self, ids: DataFrame) -> int:
        """ids (id) go; one that isn't there makes no difference."""
        return self._append(ids.select("id", F.lit(0).cast("long").alias("seq"), F.lit(True).alias("gone"), F.lit(None).alias("embedding")))

    def replace(self, rows: DataFrame) -> int:
        """All that there was goes, rows take its place."""
        number, manifest = self._manifest()
        at = manifest["at"] + 1
        seq = F.col("seq").cast("long") if "seq" in rows.columns else F.lit(0).cast("long")
        name = self._write(rows.select("id", F.lit(at).cast("long").alias("at"), seq.alias("seq"), F.lit(False).alias("gone"), F.col("embedding").cast("array<float>").alias("embedding")))
        self._commit(number + 1, {"at": at, "segments": [{"name": name, "level": 1, "at": at}]})
        return at

    def _rows(self, segments: list[dict]) -> DataFrame:
        paths = [f"{self.folder}/segments/{s['name']}" for s in segments]
        return self.spark.read.schema(SEGMENT).parquet(*paths) if paths else self.spark.createDataFrame([], SEGMENT)

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        """The row of each id that counts; of rows equal in (at, seq) the one whose embedding sorts last."""
        order = F.struct("at", "seq", "gone", "embedding")
        return rows.groupBy("id").agg(F.max(order).alias("r")).select("id", "r.at", "r.seq", "r.gone", "r.embedding")

    def read(self) -> DataFrame:
        """id, embedding as of the newest manifest: one sum over the live segments, made before the shuffle."""
        return self._merged(self._rows(self._manifest()[1]["segments"])).where(~F.col("gone")).select("id", "embedding")

    def levels(self) -> dict[int, int]:
        """How many segments each level has."""
        out: dict[int, int] = {}
        for s in self._manifest()[1]["segments"]:
            out[s["level"]] = out.get(s["level"], 0) + 1
        return out

    def compact(self, fan: int = FAN) -> int:
        """Merges each level of ``fan`` or more segments into one of the next level, lowest first; how many merges there were.

        A merge takes all segments of a level, which are newer than those of any higher level. Removals are kept until there is
        nothing older that they could hide. What is merged is deleted once the manifest without it is made.
        """
        merges = 0
        while True:
            number, manifest = self._manifest()
            full = [level for level, n in sorted(self.levels().items()) if n >= fan]
            if not full:
                return merges
            level = full[0]
            old = [s for s in manifest["segments"] if s["level"] == level]
            rest = [s for s in manifest["segments"] if s["level"] != level]
            rows = self._merged(self._rows(old))
            if not any(s["at"] < max(o["at"] for o in old) for s in rest):
                rows = rows.where(~F.col("gone"))
            name = self._write(rows)
            self._commit(number + 1, {"at": manifest["at"], "segments": [*rest, {"name": name, "level": level + 1, "at": max(s["at"] for s in old)}]})
            for s in old:
                self._fs.delete(self._path(f"{self.folder}/segments/{s['name']}"), True)
            merges += 1
