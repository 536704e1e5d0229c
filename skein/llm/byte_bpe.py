"""Byte-level BPE by ranks: a minimal perfect hash finds whole pre-tokens, a heap over linked bytes merges the others."""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Keys to a bucket of the perfect hash, on average.
BUCKET_KEYS = 4
#: Segments and pre-tokens that a worker's memo holds before it starts anew.
MEMO_ENTRIES = 300_000


class PerfectHash:
    """Hash and displace: each of n keys has its own slot of n.

    A bucket of one key stores its slot as -(slot + 1); a larger one the least d for which its keys' places (a + (d mod 64) * b
    + d div 64) mod n are free and distinct. A key that wasn't put in lands on some slot, so the caller compares what lies there.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // BUCKET_KEYS)
        bucket, a, b = self._parts(keys)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int32)
        taken = np.zeros(self.n, bool)
        sizes = np.diff(ends)
        for k in np.argsort(-sizes, kind="stable"):
            own = order[ends[k] : ends[k + 1]]
            if len(own) <= 1:
                break
            d = 0
            while True:
                tries = np.arange(d, d + 256)
                slots = self._place(a[own][:, None], b[own][:, None], tries)
                good = ~taken[slots].any(axis=0) & np.all(np.diff(np.sort(slots, axis=0), axis=0) > 0, axis=0)
                if good.any():
                    break
                d += 256
                if d > 1 << 24:
                    raise ValueError("two keys hash alike")
            self.shift[k] = d + int(np.argmax(good))
            taken[slots[:, np.argmax(good)]] = True
        single = np.flatnonzero(sizes == 1)
        self.shift[single] = -np.flatnonzero(~taken)[: len(single)] - 1
        self.at = self.slots(keys)  # slot of each key, in the order given

    def _parts(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        import xxhash

        h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        n = np.uint64(self.n)
        bucket = ((h >> np.uint64(43)) % np.uint64(self.buckets)).astype(np.int64)
        return bucket, ((h & np.uint64(0x3FFFFF)) % n).astype(np.int64), (1 + ((h >> np.uint64(22)) & np.uint64(0x1FFFFF)) % max(n - np.uint64(1), np.uint64(1))).astype(np.int64)

    def _place(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (a + (d & 63) * b + (d >> 6)) % self.n

    def slots(self, keys: list[bytes]) -> np.ndarray:
        bucket, a, b = self._parts(keys)
        d = self.shift[bucket].astype(np.int64)
        return np.where(d < 0, -d - 1, self._place(a, b, d))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(x[0]): int(x[1]) for x in map(bytes.split, f) if x}


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        keys = list(self.ranks)
        self.hash = PerfectHash(keys)
        self.slot_key: list[bytes] = [b""] * len(keys)
        self.slot_id = np.zeros(len(keys), np.int64)
        for key, slot in zip(keys, self.hash.at.tolist()):
            self.slot_key[slot], self.slot_id[slot] = key, self.ranks[key]
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for key, rank in self.ranks.items():
            by_id[rank] = key
        self.lengths = np.fromiter(map(len, by_id), np.int64, size)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.segments: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: the pair of least rank, leftmost first, is joined until none has a rank."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # of the part that begins here; 0: joined to the one before
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, mid, last = heappop(heap)
            if end[i] != mid or mid >= n or end[mid] != last:
                continue
            end[i], end[mid] = last, 0
            if last < n:
                before[last] = i
                if (r := ranks.get(piece[i : end[last]])) is not None:
                    heappush(heap, (r, i, last, end[last]))
            p = before[i]
            if p >= 0 and (r := ranks.get(piece[p:last])) is not None:
                heappush(heap, (r, p, i, last))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _resolve(self, tokens: list[str]) -> None:
        """First tier for all of them at once, second tier for those that aren't in the vocabulary."""
        raw = [t.encode("utf-8", "replace") for t in tokens]
        slots = self.hash.slots(raw)
        ids = self.slot_id[slots].astype("<u4").tobytes()
        key, memo = self.slot_key, self.tokens
        for k, (slot, token, piece) in enumerate(zip(slots.tolist(), tokens, raw)):
            memo[token] = ids[4 * k : 4 * k + 4] if key[slot] == piece else np.asarray(self.merge(piece), "<u4").tobytes()

    @staticmethod
    def _segments(text: str) -> list[str]:
        """Cuts before each single space that a non-white character follows: no match of the pattern reaches over it."""
        parts = text.split(" ")
        out = [parts[0]]
        for x in parts[1:]:
            if x and not x[0].isspace():
                out.append(" " + x)
            else:
                out[-1] += " " + x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.segments) > MEMO_ENTRIES or len(self.tokens) > MEMO_ENTRIES:
            self.segments.clear()
            self.tokens.clear()
        split = [self._segments(t) if t else [] for t in texts]
        new = [s for s in dict.fromkeys(s for x in split for s in x) if s not in self.segments]
        if new:
            find = self.pattern.findall
            found = [find(s) for s in new]
            if unknown := [t for t in dict.fromkeys(t for x in found for t in x) if t not in self.tokens]:
                self._resolve(unknown)
            get = self.tokens.__getitem__
            for s, x in zip(new, found):
                self.segments[s] = b"".join(map(get, x))
        get = self.segments.__getitem__
        return [b"".join(map(get, x)) for x in split]

    def decode(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        size = self.lengths[i]
        ends = np.cumsum(size)
        if len(i) == 0:
            return b""
        return self.flat[np.arange(int(ends[-1])) + np.repeat(self.begins[i] - ends + size, size)].tobytes()


def coder(path: str, pattern: str) -> ByteBPE:
    """One per worker process and file."""
    return common.held(("bytes", path, pattern), lambda: ByteBPE(path, pattern))


def encode_documents(spark: SparkSession, docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs`` (doc_id, text), and the ids if asked for.

    Null text counts as empty: no ids, the digests of nothing. Rows with equal or null doc_id give a row each. Bytes that
    are no UTF-8 become U+FFFD first, as the library's callers must do. More columns are not read.
    """
    common.bounded_batches(spark)

    def run(batches):
        import pyarrow as pa

        bpe = coder(path, pattern)
        for b in batches:
            ids = bpe.encode([(x or b"").decode("utf-8", "replace") for x in b.column(1).to_pylist()])
            columns = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
