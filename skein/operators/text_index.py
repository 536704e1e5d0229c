"""A persisted inverted index over the texts of nodes: searches read where runs of three characters lie, not the nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

#: Texts that are indexed, by their number in the index.
TEXTS = ("name", "path", "relative_path")
NAME, PATH = 0, 1
GRAM = 3
#: Folders that runs are dealt out over by hash, so that a search lists and opens only those of its own runs.
SHELVES = 32

PLACE = "gram string, pos long, id long, field int, at int, size int, shelf int"


def _shelf(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SHELVES)).cast("int")


def cover(text: str, counts: dict[str, int]) -> list[int]:
    """Offsets of runs that together hold every character of ``text``, with the fewest places by ``counts``."""
    last = len(text) - GRAM
    best: list[tuple[int, list[int]]] = []
    for o in range(last + 1):
        before = min(best[max(0, o - GRAM) : o], default=(0, []), key=lambda b: b[0])
        best.append((before[0] + counts.get(text[o : o + GRAM], 0), [*before[1], o]))
    return best[last][1]


class TextIndex:
    """The index in a folder of the shared storage: ``nodes`` (all columns, by pos), ``places`` (each run of each text: where it
    lies) and ``counts`` (how many places a run has).

    Places are sorted by run and pos within their shelf, so a search prunes folders by the shelf and row groups by their least and
    greatest run; a run that all texts share is dealt out over files by pos. Runs that hold every character of the query between
    them, the rarest such, are met at places that agree on where it starts, so no text is read to confirm a match. Ids are unique,
    as in any graph; null texts hold nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.nodes = spark.read.parquet(f"{self.folder}/nodes")
        self.places = spark.read.schema(PLACE).parquet(f"{self.folder}/places")
        self.counts = spark.read.schema("gram string, n long").parquet(f"{self.folder}/counts")

    @classmethod
    def build(cls, nodes: DataFrame, folder: str) -> "TextIndex":
        """Writes the index of ``nodes`` (id, pos, name, path and, if there is one, relative_path) into a new folder."""
        spark, folder = nodes.sparkSession, folder.rstrip("/")
        nodes.repartitionByRange("pos").sortWithinPartitions("pos").write.parquet(f"{folder}/nodes")
        kept = spark.read.parquet(f"{folder}/nodes")
        texts = F.array(*[F.struct(F.lit(k).alias("field"), F.lower(c).alias("text")) for k, c in enumerate(TEXTS) if c in nodes.columns])
        rows = kept.select(F.col("pos").cast("long"), F.col("id").cast("long"), F.explode(texts).alias("t")).select("pos", "id", "t.field", "t.text", F.length("t.text").alias("size"))
        # One pass over a text, whatever its length: a character is taken, and it and the two after it are looked at.
        runs = F.regexp_extract_all("text", F.lit(r"(?s)(?=(.{3}))."), F.lit(1))
        places = rows.where(F.col("size") >= GRAM).select("pos", "id", "field", "size", F.posexplode(runs).alias("at", "gram"))
        places = places.select("gram", "pos", "id", "field", "at", "size", _shelf(F.col("gram")).alias("shelf"))
        places = places.repartitionByRange("shelf", "gram", "pos").sortWithinPartitions("shelf", "gram", "pos", "field", "at")
        places.write.partitionBy("shelf").parquet(f"{folder}/places")
        counts = spark.read.schema(PLACE).parquet(f"{folder}/places").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/counts")
        return cls(spark, folder)

    def starts(self, text: str) -> DataFrame:
        """pos, id, field, start, size of every place where ``text``, lower-cased and of at least GRAM characters, lies.

        What reaches the driver is a count for each run of the query.
        """
        grams = sorted({text[o : o + GRAM] for o in range(len(text) - GRAM + 1)})
        counts = {r.gram: r.n for r in self.counts.where(F.col("gram").isin(grams)).collect()}
        if len(counts) < len(grams):
            return self.places.where(F.lit(False)).select("pos", "id", "field", F.col("at").alias("start"), "size")
        offsets: dict[str, list[int]] = {}
        for o in (chosen := cover(text, counts)):
            offsets.setdefault(text[o : o + GRAM], []).append(o)
        mine = self.places.where(F.col("shelf").isin([_shelf(F.lit(g)) for g in offsets]) & F.col("gram").isin(list(offsets)))
        known = F.create_map(*[x for g, at in offsets.items() for x in (F.lit(g), F.array(*[F.lit(o) for o in at]))])
        met = mine.select("pos", "id", "field", "size", "at", F.explode(known[F.col("gram")]).alias("o")).select("pos", "id", "field", (F.col("at") - F.col("o")).alias("start"), "size")
        if len(chosen) == 1:
            return met
        keys = ["pos", "id", "field", "start", "size"]
        return met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(chosen)).select(*keys)

    def _rows(self, report: DataFrame) -> DataFrame:
        """The nodes of a report (pos, id and more), which holds no more rows than its limit: read by their pos."""
        found = report.collect()
        own = self.spark.createDataFrame(found, report.schema).drop("pos")
        nodes = self.nodes.where(F.col("pos").isin([r.pos for r in found]))
        return nodes.drop(*[c for c in own.columns if c != "id"]).join(F.broadcast(own), "id")

    def search_nodes(self, query: str, kind: str | None = None, extension: str | None = None, limit: int = 20) -> DataFrame:
        """What ``search.search_nodes`` gives; queries of under GRAM characters read the nodes."""
        text = query.lower()
        if len(text) < GRAM:
            return search.search_nodes(self.nodes, query, kind, extension, limit)
        hits = self.starts(text).select("pos", "id").distinct()
        if kind or extension:
            allowed = self.nodes
            if kind:
                allowed = allowed.where(F.lower("kind") == kind.lower())
            if extension:
                allowed = allowed.where(search.extension_of("path") == extension)
            hits = hits.join(allowed.select("id"), "id", "left_semi")
        return self._rows(search._limited(hits.select("pos", "id"), limit)).orderBy("pos")

    def find_by_text(self, query: str, limit: int = 30) -> DataFrame:
        """What ``search.find_by_text`` gives; queries of under GRAM characters read the nodes."""
        text = query.lower()
        if len(text) < GRAM:
            return search.find_by_text(self.nodes, query, limit)
        named, first = F.col("field") == NAME, F.col("start") == 0
        score = F.when(named & first & (F.col("size") == len(text)), 1.0).when(named & first, 0.9).when(named, 0.7).when(F.col("field") == PATH, 0.5)
        best = self.starts(text).groupBy("pos", "id").agg(F.max(score).alias("score")).where("score is not null")
        return self._rows(best.orderBy(F.desc("score"), "id").limit(limit)).orderBy(F.desc("score"), "id")

    def run_search(self, query: str, limit: int = 30) -> DataFrame:
        """Queries of under two characters find nothing."""
        return self.find_by_text(query, limit if len(query) >= 2 else 0)
