"""SimHash near-duplicates found through vantage-point trees over fingerprints.

Two fingerprints that differ in at most RADIUS bits differ in at most RADIUS // BLOCKS bits of some block of their bits
(pigeonhole), and the Hamming distance over a block is a metric too. So there is a vantage-point tree for each block. A node
sends what lies within its median distance of the vantage point inside and the rest outside; by the triangle inequality only
what lies less than the block's radius within the boundary can have a partner outside, and is sent there as well. Each pair
within the radius so meets in some leaf. The upper levels, fitted on a bounded sample, are the shards; each task goes on
splitting its shard by the same rule and compares what is left exactly, over all 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components, named

WORDS = 4
SEED = 42
RADIUS = 4
BLOCKS = 3
#: Fingerprints the shards' trees are fitted on, at least; deeper trees take SAMPLE_LEAF for each shard, 2**19 at most.
SAMPLE = 8192
SAMPLE_LEAF = 8
#: Fingerprints in a shard, about: enough for SHARDS shards a block to begin with, so that few are sent to more than one, but
#: within these; the task that gets a shard goes on splitting it. Shards of more than HOT_ROWS, or four times as many as
#: meant, are dealt out by pairs of chunks.
SHARD_ROWS = (16_384, 5_000_000)
SHARDS = 24
HOT_ROWS = 200_000
#: Fingerprints that are compared directly.
LEAF_ROWS = 256
#: Deepest shard tree: 2**16 shards a block.
MOST_LEVELS = 16
#: Shingles hashed before their bits are summed.
SUM_SHINGLES = 200_000


def text_hashes(text: bytes | None, shingle: int = WORDS) -> list[int]:
    """XXH64 of each word shingle; fewer words than a shingle make one; no word none."""
    import xxhash

    words = text.lower().split() if text else []  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, SEED)]
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    begins = (ends - size + 1)[: len(words) - shingle + 1].tolist()
    h, view = xxhash.xxh64_intdigest, memoryview(line)
    return [h(view[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist())]


def fingerprints_of(texts: list[bytes | None]) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is set if it is set in over half of a text's hashes."""
    out = np.zeros(len(texts), np.uint64)
    held: list[int] = []
    spans: list[tuple[int, int, int]] = []

    def fold():
        if spans:
            bits = np.unpackbits(np.asarray(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for k, a, b in spans:
                most = 2 * bits[a:b].sum(axis=0, dtype=np.int64) > b - a
                out[k] = np.packbits(most, bitorder="little").view("<u8")[0]
            held.clear()
            spans.clear()

    for k, text in enumerate(texts):
        hashes = text_hashes(text)
        if hashes:
            spans.append((k, len(held), len(held) + len(hashes)))
            held.extend(hashes)
            if len(held) >= SUM_SHINGLES:
                fold()
    fold()
    return out.view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (signed 64 bits) of each row; null or wordless text has 0."""

    def run(batches):
        import pyarrow as pa

        common.let_go()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(b.column(1).to_pylist()))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS) -> list[np.uint64]:
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:])]


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def choose_vantage(values: np.ndarray) -> tuple[np.uint64, int]:
    """Of a few of the values, that whose distances to the others spread most, and their median."""
    tried = values[:: max(1, len(values) // 6)][:6]
    spread = [distance(values, v).var() for v in tried]
    v = tried[int(np.argmax(spread))]
    return v, int(np.median(distance(values, v)))


class ShardTree:
    """The upper levels of a block's tree, complete to ``levels``, in heap order."""

    def __init__(self, sample: np.ndarray, mask: np.uint64, levels: int, radius: int):
        self.mask, self.levels, self.radius = mask, levels, radius
        self.vantage, self.bound = np.zeros((1 << levels) - 1, np.uint64), np.zeros((1 << levels) - 1, np.int16)
        at = [sample & mask]
        for node in range(len(self.vantage)):
            own = at[node]
            if len(own):
                self.vantage[node], self.bound[node] = choose_vantage(own)
            d = distance(own, self.vantage[node])
            at += [own[d <= self.bound[node]], own[d > self.bound[node]]]

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of fps, shards): every fingerprint in its own shard and in those its ball reaches over a boundary."""
        rows, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        values = fps & self.mask
        for _ in range(self.levels):
            d = distance(values[rows], self.vantage[node])
            outside = d > self.bound[node]
            over = ~outside & (d + self.radius > self.bound[node])
            rows, node = np.concatenate([rows, rows[over]]), np.concatenate([2 * node + 1 + outside, 2 * node[over] + 2])
        return rows, node - ((1 << self.levels) - 1)


def _chains(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what lies within ``radius``, each reached row compared once with those not reached yet."""
    out, free = [], fps
    while len(free) > 1:
        frontier, free = [free[0]], free[1:]
        while frontier and len(free):
            x = frontier.pop()
            near = distance(free, x) <= radius
            if near.any():
                got, free = free[near], free[~near]
                frontier.extend(got)
                out.append((np.full(len(got), x, np.uint64), got))
    return out


def link(fps: np.ndarray, mask: np.uint64, block_radius: int, radius: int = RADIUS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (pairs of fingerprints) that join all of these distinct fingerprints that meet in this block's tree."""
    out, work = [], [fps]
    while work:
        own = work.pop()
        n = len(own)
        if n < 2:
            continue
        if n > LEAF_ROWS:
            v, bound = choose_vantage(own & mask)
            d = distance(own & mask, v)
            inner, outer = own[d <= bound], own[d + block_radius > bound]
            if max(len(inner), len(outer)) < 0.9 * n:
                work += [inner, outer]
                continue
        if n <= 4 * LEAF_ROWS:
            i, j = np.nonzero(np.triu(distance(own[:, None], own[None, :]) <= radius, 1))
            if len(i) <= 4 * n:
                out.append((own[i], own[j]))
                continue
        out += _chains(own, radius)
    return out


def links_of(spark: SparkSession, distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """u, v: links between the distinct fingerprints ``fp`` that join exactly those within ``radius`` by steps."""
    n = distinct.count()
    rows = max(SHARD_ROWS[0], min(SHARD_ROWS[1], n // SHARDS))
    levels = min(MOST_LEVELS, max(0, math.ceil(math.log(max(1, n) / rows) / math.log(1 / 0.585)) if n else 0))
    hot_rows = max(HOT_ROWS, 4 * rows if rows > SHARD_ROWS[0] else 0)
    # bounded (see SAMPLE), taken by a hash of their own
    sample = np.asarray([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, SAMPLE_LEAF << levels)).collect()], np.int64).view(np.uint64)
    masks, block_radius = block_masks(blocks), radius // blocks
    trees = [ShardTree(sample, m, levels, block_radius) for m in masks]

    def routed(fps: np.ndarray):
        parts = [(rows, (np.int64(k) << MOST_LEVELS) | shard) for k, (rows, shard) in enumerate(t.route(fps) for t in trees)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def count(batches):
        import pyarrow as pa

        total: dict[int, int] = {}
        for b in batches:
            shards, counts = np.unique(routed(b.column(0).to_numpy().view(np.uint64))[1], return_counts=True)
            for s, c in zip(shards.tolist(), counts.tolist()):
                total[s] = total.get(s, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["shard", "n"])

    # as many rows as there are shards over the bound
    hot = {r[0]: -(-r[1] // (hot_rows // 2)) for r in distinct.select("fp").mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > hot_rows).collect()}

    def deal(batches):
        import pyarrow as pa

        for b in batches:
            fps = b.column(0).to_numpy()
            rows, shard = routed(fps.view(np.uint64))
            task = shard << 32
            for s, chunks in hot.items():
                at = np.flatnonzero(shard == s)
                if len(at):
                    own = (fps[rows[at]].view(np.uint64) % np.uint64(chunks)).astype(np.int64)
                    other = np.arange(chunks)
                    pair = np.minimum(own[:, None], other) * chunks + np.maximum(own[:, None], other)
                    rows = np.concatenate([np.delete(rows, at), np.repeat(rows[at], chunks)])
                    task = np.concatenate([np.delete(task, at), ((np.int64(s) << 32) | pair).ravel()])
                    shard = np.concatenate([np.delete(shard, at), np.full(len(at) * chunks, -1)])
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(fps[rows])], ["task", "fp"])

    def compare(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []
        current = None

        def finish():
            got = link(np.concatenate(held).view(np.uint64), masks[current >> 32 >> MOST_LEVELS], block_radius, radius) if held else []
            if got:
                u, v = (np.concatenate([g[k] for g in got]).view(np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            task, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(task)) + 1
            for a, z in zip([0, *edges], [*edges, len(task)]):
                if a == z:
                    continue
                if task[a] != current:
                    yield from finish()
                    held, current = [], int(task[a])
                held.append(fps[a:z].copy())
        yield from finish()

    return distinct.select("fp").mapInArrow(deal, "task long, fp long").repartition("task").sortWithinPartitions("task").mapInArrow(compare, "u long, v long")


def near_duplicates(spark: SparkSession, docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable by links) of each row of ``docs``.

    docs: doc_id, text; more columns are not read. Null and wordless texts have fingerprint zero, linked like any other.
    Equal texts share a fingerprint and so a component, repeated rows are kept. A row without doc_id takes part; its
    component's least doc_id is taken over the others, null if there are none. No rows: no rows.
    """
    common.bounded_batches(spark)
    prints = common.cut(spark, fingerprints(docs), "fingerprints")
    distinct = common.cut(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(spark, links_of(spark, distinct, radius)).select(F.col("id").alias("fp"), "component")
    known = common.cut(spark, distinct.join(joined, "fp", "left"), "classes")
    members = known.where("component is not null")
    names = members.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = known.where("component is null").select("fp", F.col("least").alias("component_id")).unionByName(named(members, names, "component").select("fp", "component_id"))
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
