"""Documents as one concatenated array of ids with Elias-Fano document boundaries.

A store is a folder of shards in ascending doc_id order. A shard is ``<name>.ids`` (little-endian unsigned ids, one after
the other) and ``<name>.ef`` (a header, the number of rows without doc_id, the doc_ids less the smallest, and the places
where documents begin, both Elias-Fano coded). Only shards named in the manifest count, so files of lost or repeated task
attempts do no harm.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .elias_fano import EliasFano
from .wordbpe import encoder

MAGIC = b"SKEF"
_HEAD = struct.Struct("<4sBxxxqQQ")  # magic, bytes an id, smallest doc_id, rows without doc_id, ids

#: Bytes of text that go into one shard, about; larger where there would be more than MOST_SHARDS.
SHARD_TEXT_BYTES = 48 << 20
MOST_SHARDS = 50_000
#: Documents whose boundaries are selected, and whose ids are read, at once.
READ_DOCS = 1024

MANIFEST = "shard int, name string, n_docs long, n_ids long"


def encode_documents(docs: DataFrame, path: str, end_id: int | None, splits: list[int]) -> DataFrame:
    """doc_id, ids (binary) and shard: the place of doc_id among ``splits``; rows without doc_id come first."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        end = b"" if end_id is None else np.asarray([end_id], enc.dtype).tobytes()
        cuts = np.asarray(splits, np.int64)
        for b in batches:
            ids = [x + end for x in enc.encode(b.column(1).to_pylist())]
            key = b.column(0)
            place = np.searchsorted(cuts, key.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([key, pa.array(ids, pa.binary()), pa.array(place.astype(np.int32))], ["doc_id", "ids", "shard"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, ids binary, shard int")


class _Writer:
    """One shard; holds boundaries and doc_ids, never the ids."""

    def __init__(self, folder: str, shard: int, width: int):
        self.fs, self.at = common.file_system(folder)
        self.shard, self.width, self.name = shard, width, f"{shard:06d}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.at}/{self.name}.ids", compression=None)
        self.keys, self.lengths, self.nulls = [], [], 0

    def add(self, keys: list, ids: list[bytes]) -> None:
        self.out.write(b"".join(ids))
        self.nulls += sum(k is None for k in keys)
        self.keys.append(np.asarray([k for k in keys if k is not None], np.int64))
        self.lengths.append(np.fromiter((len(x) // self.width for x in ids), np.int64, len(ids)))

    def close(self) -> dict:
        self.out.close()
        keys, lengths = np.concatenate(self.keys), np.concatenate(self.lengths)
        least = int(keys[0]) if len(keys) else 0
        starts = np.concatenate([[0], np.cumsum(lengths)])
        raw = _HEAD.pack(MAGIC, self.width, least, self.nulls, int(starts[-1]))
        # differences wrap to unsigned, so any two signed doc_ids have one
        raw += EliasFano.encode((keys - np.int64(least)).view(np.uint64)).to_bytes() + EliasFano.encode(starts).to_bytes()
        with self.fs.open_output_stream(f"{self.at}/{self.name}.ef", compression=None) as out:
            out.write(raw)
        return {"shard": self.shard, "name": self.name, "n_docs": len(lengths), "n_ids": int(starts[-1])}


class Shard:
    """Reads one shard; ``starts`` gives a document's place without any table of offsets."""

    def __init__(self, folder: str, name: str):
        self.fs, at = common.file_system(folder)
        self.path = f"{at}/{name}.ids"
        with self.fs.open_input_stream(f"{at}/{name}.ef", compression=None) as f:
            raw = f.read()
        magic, self.width, self.least, self.nulls, self.n_ids = _HEAD.unpack_from(raw, 0)
        if magic != MAGIC:
            raise ValueError(f"{name}.ef is no boundary file")
        self.keys, at = EliasFano.from_bytes(raw, _HEAD.size)
        self.starts, _ = EliasFano.from_bytes(raw, at)
        self.n_docs = self.starts.n - 1

    def doc_ids(self, first: int, last: int) -> list:
        none = [None] * max(0, min(self.nulls, last) - first)
        at = np.arange(max(first, self.nulls), last) - self.nulls
        return none + (self.keys.select(at).view(np.int64) + np.int64(self.least)).tolist()

    def read(self, first: int, last: int):
        """(doc_id, place of its first id in the shard, its ids as bytes) of the documents from first to before last."""
        ends = self.starts.select(np.arange(first, last + 1)).astype(np.int64)
        with self.fs.open_input_file(self.path) as f:
            f.seek(int(ends[0]) * self.width)
            raw = memoryview(f.read(int(ends[-1] - ends[0]) * self.width))
        cuts = (ends - ends[0]) * self.width
        for k, key in enumerate(self.doc_ids(first, last)):
            yield key, int(ends[k]), raw[cuts[k] : cuts[k + 1]]


def write(spark: SparkSession, docs: DataFrame, path: str, folder: str, end_id: int | None = None, shard_bytes: int = SHARD_TEXT_BYTES) -> list[dict]:
    """Writes ``docs`` (doc_id, text; more columns are not read) and returns the manifest, in shard order.

    One pass over the texts' lengths and doc_ids places the cuts between shards; then each text is encoded once and only
    ids are shuffled, straight to their shard, and sorted there. Equal doc_ids stay together, in the order of their ids.
    Null or empty text: only the end id. Null doc_id: before all others. No rows: no shards.
    """
    common.bounded_batches(spark)
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    n = min(MOST_SHARDS, max(1, -(-size // shard_bytes)))
    splits: list[int] = []
    if n > 1:
        ask = [k / n for k in range(1, n)]
        # a long text counts as often as it is longer than the mean: twice as many rows as documents at most
        often = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / F.lit(size / rows)).cast("int")
        weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), often))))
        splits = sorted(set(weighed.agg(F.percentile_approx("doc_id", ask, max(10_000, 20 * n))).first()[0] or []))

    def put(batches):
        import pyarrow as pa

        writer, width = None, encoder(path).dtype.itemsize
        for b in batches:
            if b.num_rows:
                writer = writer or _Writer(folder, b.column(2)[0].as_py(), width)
                writer.add(b.column(0).to_pylist(), b.column(1).to_pylist())
        if writer:
            yield pa.RecordBatch.from_pylist([writer.close()], schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    coded = encode_documents(docs, path, end_id, splits).repartitionById(len(splits) + 1, F.col("shard")).sortWithinPartitions("doc_id", "ids")
    # a row for each shard, as many as shards
    return sorted((r.asDict() for r in coded.mapInArrow(put, MANIFEST).collect()), key=lambda r: r["shard"])


def read(spark: SparkSession, manifest: list[dict], folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document of the store."""
    start, rows = 0, []
    for k, m in enumerate(manifest):
        rows.append((k, m["name"], start))
        start += m["n_ids"]

    def get(batches):
        import pyarrow as pa

        for b in batches:
            for name, base in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                shard = Shard(folder, name)
                for first in range(0, shard.n_docs, READ_DOCS):
                    got = [(key, base + at, len(ids) // shard.width, _crc(ids, shard.width)) for key, at, ids in shard.read(first, min(shard.n_docs, first + READ_DOCS))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    names = spark.createDataFrame(rows, "k int, name string, start long")
    if rows:
        names = names.repartitionById(len(rows), F.col("k"))
    return names.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _crc(ids, width: int) -> int:
    return zlib.crc32(ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())


def store_documents(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the store into the shared folder and reads it back."""
    folder = common.shared_dir(spark, "tokens")
    return read(spark, write(spark, docs, path, folder, end_id), folder)
