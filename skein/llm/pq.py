"""Embedding near-duplicates by product quantisation with an exact cosine at the end.

Unit vectors are put into the inverted list of their nearest coarse centroid, with the residual's code in each subspace and
the length of what the code misses. A vector is a query to its own list and to those whose centroid is at most a margin
farther off than its own; the margin is set on simulated pairs at the limit itself, so that a partner lies in a probed list
with near certainty, and either of the two finding the other is enough. In a list, a table look-up per subspace gives the
distance to each coded vector; by the triangle inequality none farther than the limit plus what its code misses can be a
partner, so the tables drop no pair; the exact cosine in double precision decides the rest.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components, named

COSINE = 0.95
#: Vectors that centroids and codebooks are fitted on; every vector is coded and compared.
FIT_ROWS = 16_384
MOST_LISTS = 4096
SUBSPACES = 16
CODES = 16
ROUNDS = 8
#: Simulated pairs at the limit, and how many of them may lie beyond the margin from one side.
PAIRS = 20_000
MISSED = 1e-3
#: Residents of one task; a longer list is dealt out over several.
CHUNK_ROWS = 20_000
QUERY_ROWS = 256


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centroids, subspace codebooks and the probing margin."""

    def __init__(self, sample: np.ndarray, lists: int, cosine: float = COSINE, seed: int = 42):
        rng = np.random.default_rng(seed)
        x = unit(sample)
        self.dim = x.shape[1]
        self.centroids = _kmeans(x, min(lists, len(x)), rng)
        own, _ = self.home(x)
        rest = x - self.centroids[own]
        self.cuts = [self.dim * k // SUBSPACES for k in range(SUBSPACES + 1)] if self.dim >= SUBSPACES else list(range(self.dim + 1))
        self.books = [_kmeans(rest[:, a:b], min(CODES, len(x)), rng) for a, b in zip(self.cuts, self.cuts[1:])]
        self.limit = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
        # pairs at the limit: each turned off its own direction in a random one
        a = x[rng.integers(0, len(x), PAIRS)]
        turn = rng.standard_normal(a.shape)
        turn = turn - (turn * a).sum(1, keepdims=True) * a
        turn = unit(np.where(np.abs(turn).max(axis=1, keepdims=True) > 0, turn, a))  # of one component: there is no other direction
        b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * turn
        d = self.squared(a)
        gap = d[np.arange(PAIRS), np.argmin(self.squared(b), axis=1)] - d.min(axis=1)
        self.margin = float(np.quantile(gap, 1 - MISSED))

    def squared(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the centroids, less the vector's own square."""
        return (self.centroids**2).sum(1) - 2 * x @ self.centroids.T

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.squared(x)
        return np.argmin(d, axis=1), d

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes by subspace and the length of what they miss."""
        rest = x - self.centroids[home]
        codes, miss = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            d = (book**2).sum(1) - 2 * rest[:, a:b] @ book.T
            codes[:, m] = np.argmin(d, axis=1)
            miss += ((rest[:, a:b] - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(miss)

    def tables(self, x: np.ndarray, at: int) -> list[np.ndarray]:
        """For each subspace, squared distances of the queries' residuals in list ``at`` to the codewords."""
        rest = x - self.centroids[at]
        return [((rest[:, None, a:b] - book[None]) ** 2).sum(2) for book, a, b in zip(self.books, self.cuts, self.cuts[1:])]

    def probes(self, home: int, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether vectors of list ``home`` are queries to the lists ``at``."""
        c = self.centroids
        d = (c[at] ** 2).sum(1) - 2 * (vectors * c[at]).sum(1)
        return d - ((c[home] ** 2).sum() - 2 * vectors @ c[home]) <= self.margin


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors of finite ones that are not zero; scaled first, so that no square over- or underflows."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _List:
    """One task's residents; queries stream by."""

    def __init__(self, q: Quantiser, at: int, cosine: float):
        self.q, self.at, self.cosine = q, at, cosine
        self.parts: list[tuple] = []

    def ready(self):
        self.node, self.n, self.x, self.codes, self.miss = (np.concatenate([p[k] for p in self.parts]) for k in range(5)) if self.parts else (np.zeros(0, np.int64),) * 5
        self.parts = []
        self.back = np.zeros(len(self.node), np.int64)
        self.label = np.arange(len(self.node))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Residents i and j are linked: both get the least label either can reach."""
        label = self.label
        while True:
            a, b = label[i], label[j]
            if np.array_equal(a, b):
                return
            least = np.minimum(a, b)
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            while not np.array_equal(label, up := label[label]):
                label[:] = up

    def ask(self, node, n, home, x):
        """(query, links of its own) and (query, a resident) for queries that link with residents."""
        counts, edges = [], []
        if not len(self.node):
            return counts, edges
        for k in range(0, len(node), QUERY_ROWS):
            s = slice(k, k + QUERY_ROWS)
            d = np.zeros((len(node[s]), len(self.node)))
            for m, t in enumerate(self.q.tables(x[s], self.at)):
                d += t[:, self.codes[:, m]]
            i, j = np.nonzero(np.sqrt(d) <= self.q.limit + self.miss)
            other = node[s][i] != self.node[j]
            i, j = i[other], j[other]
            near = np.zeros(len(i), bool)
            for z in range(0, len(i), 100_000):
                p = slice(z, z + 100_000)
                near[p] = np.einsum("ij,ij->i", x[s][i[p]], self.x[j[p]]) >= self.cosine
            i, j = i[near], j[near]
            if not len(i):
                continue
            own = np.zeros(len(node[s]), np.int64)
            np.add.at(own, i, self.n[j])
            hit = np.flatnonzero(own)
            counts.append((node[s][hit], own[hit]))
            # a resident that is no query to the asker's list hears of the link here
            deaf = ~self.q.probes(self.at, self.x[j], home[s][i])
            np.add.at(self.back, j[deaf], n[s][i[deaf]])
            first = np.concatenate([[True], i[1:] != i[:-1]])
            lead = j[first][np.cumsum(first) - 1]
            edges.append((node[s][i[first]], self.node[j[first]]))
            self.join(lead, j)
        return counts, edges

    def rest(self):
        hit, moved = np.flatnonzero(self.back), np.flatnonzero(self.label != np.arange(len(self.label)))
        return [(self.node[hit], self.back[hit])], [(self.node[moved], self.node[self.label[moved]])]


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding; more columns are not read).

    A vector that is null, empty, zero, or that holds null, NaN or infinity has no link and is its own component. Vectors are
    compared with all others of their length, a length after the other. Equal vectors link; they are compared once for all
    their rows. Rows without vec_id take part, but give no component its name. No rows: no rows.
    """
    common.bounded_batches(spark)
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce((F.size(e) > 0) & ~bad & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, e).alias("embedding")).withColumn("hash", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    distinct = rows.where("hash is not null").groupBy("hash", "embedding").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    nodes = common.cut(spark, distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    # a row for each length
    lengths = nodes.groupBy(F.size("embedding").alias("dim")).count().orderBy("dim").collect()
    counts, links = None, None
    for dim, total in lengths:
        found = common.cut(spark, _found(spark, nodes.where(F.size("embedding") == dim).select("node", "embedding", "n"), dim, total, cosine), "found")
        counts = found.where("v is null") if counts is None else counts.unionByName(found.where("v is null"))
        links = found.where("v is not null") if links is None else links.unionByName(found.where("v is not null"))
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    joined = components(spark, links.select("u", "v")).select(F.col("id").alias("node"), "component")
    known = common.cut(spark, nodes.select("node", "hash", "n", "least").join(joined, "node", "left"), "classes")
    members = known.where("component is not null")
    names = members.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.where("component is null").withColumn("component_id", F.col("least")).unionByName(named(members, names, "component"))
    counts = counts.groupBy("u").agg(F.sum("links").alias("links"))
    by_node = known.join(counts, F.col("node") == F.col("u"), "left").select("node", "hash", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = _of_rows(spark, rows, nodes, by_node)
    component = F.when(F.col("hash").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _of_rows(spark: SparkSession, rows: DataFrame, nodes: DataFrame, by_node: DataFrame) -> DataFrame:
    """vec_id, hash, component_id and n_links of each row; vectors that only share their hash are told apart by themselves."""
    by_node = common.cut(spark, by_node, "by_node")
    shared = common.cut(spark, nodes.groupBy("hash").count().where("count > 1").select("hash"), "shared")
    plain = rows.select("vec_id", "hash").join(by_node.select("hash", "component_id", "n_links"), "hash", "left")
    if shared.isEmpty():
        return plain
    plain = rows.join(shared, "hash", "left_anti").select("vec_id", "hash").join(by_node.select("hash", "component_id", "n_links"), "hash", "left")
    told = nodes.join(shared, "hash", "left_semi").select("hash", "embedding", "node").join(by_node.select("node", "component_id", "n_links"), "node")
    return plain.unionByName(rows.join(shared, "hash", "left_semi").join(told, ["hash", "embedding"]).select("vec_id", "hash", "component_id", "n_links"))


def _found(spark: SparkSession, nodes: DataFrame, dim: int, total: int, cosine: float) -> DataFrame:
    """u, null, links: links of u to be summed; u, v, null: links that join; over nodes (node, embedding, n) of one length."""
    number = nodes.schema["embedding"].dataType.elementType
    wide = np.dtype("<f4" if isinstance(number, T.FloatType) else "<f8")
    # bounded: FIT_ROWS vectors, taken by a hash
    sample = np.asarray([r[0] for r in nodes.orderBy(F.xxhash64("embedding"), "embedding").limit(FIT_ROWS).select("embedding").collect()], np.float64)
    q = Quantiser(sample, min(MOST_LISTS, max(1, math.isqrt(total))), cosine)

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(wide).reshape(-1, dim)
            x = unit(raw)
            home, d = q.home(x)
            codes, miss = q.encode(x, home)
            asked = d - d[np.arange(len(x)), home][:, None] <= q.margin
            probes = pa.array([np.flatnonzero(r).astype(np.int32) for r in asked], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(home.astype(np.int32)), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(miss), probes], ["node", "n", "vector", "home", "codes", "miss", "probes"])

    coded = nodes.select("node", "embedding", "n").mapInArrow(assign, "node long, n long, vector binary, home int, codes binary, miss double, probes array<int>")
    coded = common.cut(spark, coded, "coded")
    # as many rows as there are lists longer than a chunk
    chunks = {r[0]: -(-r[1] // CHUNK_ROWS) for r in coded.groupBy("home").count().where(F.col("count") > CHUNK_ROWS).collect()}
    parts = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in chunks.items() for v in kv]), F.col("list")), F.lit(1)) if chunks else F.lit(1)
    resident = coded.withColumn("list", F.col("home")).select((F.col("list").cast("long") * 65536 + F.pmod(F.col("node"), parts)).alias("task"), F.lit(0).alias("kind"), "node", "n", "home", "vector", "codes", "miss")
    asking = coded.select("node", "n", "home", "vector", F.explode("probes").alias("list"))
    asking = asking.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select((F.col("list").cast("long") * 65536 + F.col("part")).alias("task"), F.lit(1).alias("kind"), "node", "n", "home", "vector", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("miss"))

    def compare(batches):
        import pyarrow as pa

        def rows_of(counts, edges):
            blank = lambda v: pa.nulls(len(v), pa.int64())
            for v, c in counts:
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array(v), blank(v), pa.array(c)], ["u", "v", "links"])
            for a, c in edges:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), blank(a)], ["u", "v", "links"])

        current, own, open_ = None, None, False
        for b in batches:
            if not b.num_rows:
                continue
            task, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(task) != 0) | (np.diff(kind) != 0)) + 1
            for a, z in zip([0, *edges], [*edges, len(task)]):
                part = b.slice(a, z - a)
                node, n, home = (part.column(k).to_numpy() for k in (2, 3, 4))
                x = unit(np.frombuffer(b"".join(part.column(5).to_pylist()), wide).reshape(-1, dim))
                if task[a] != current:
                    if own is not None and open_:
                        yield from rows_of(*own.rest())
                    current, own, open_ = int(task[a]), _List(q, int(task[a]) >> 16, cosine), False
                if kind[a] == 0:
                    codes = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint8).reshape(len(node), -1)
                    own.parts.append((node, n, x, codes, part.column(7).to_numpy()))
                else:
                    if not open_:
                        own.ready()
                        open_ = True
                    yield from rows_of(*own.ask(node, n, home, x))
        if own is not None and open_:
            yield from rows_of(*own.rest())

    return resident.unionByName(asking).repartition("task").sortWithinPartitions("task", "kind").mapInArrow(compare, "u long, v long, links long")


#: Vectors with made neighbours, the same text for both engines: of every vector up to three more, each turned further away.
MADE = """
SELECT CAST(vec_id * 4 + k AS BIGINT) AS vec_id, {turned} AS embedding
FROM (SELECT vec_id, {doubles} AS e, {ks} AS k FROM {embeddings}) AS v WHERE k <= vec_id % 4
"""
MADE_SPARK = MADE.replace("{turned}", "transform(e, (x, i) -> x + 0.12D * k * e[(i + 1) % size(e)])").replace("{doubles}", "transform(embedding, x -> CAST(x AS DOUBLE))").replace("{ks}", "explode(sequence(0, 3))")
MADE_DUCK = MADE.replace("{turned}", "list_transform(e, lambda x, i: x + 0.12::DOUBLE * k * e[i % len(e) + 1])").replace("{doubles}", "embedding::DOUBLE[]").replace("{ks}", "unnest(range(4))").replace("{embeddings}", "embeddings")

#: Brute force over vectors that are neither null nor zero and hold neither nulls nor what isn't finite: only those have links.
LINKED = """
WITH RECURSIVE made AS MATERIALIZED ({vectors}),
fine AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM made WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
walk(id, other) AS (SELECT vec_id, vec_id FROM made UNION SELECT walk.id, v FROM walk JOIN links ON u = other)
SELECT id AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(other) AS component_id, id = min(other) AS kept
FROM walk LEFT JOIN (SELECT u, count(*) AS n FROM links GROUP BY u) l ON u = id GROUP BY id
"""
ORACLE = LINKED.replace("{vectors}", "SELECT vec_id, embedding FROM embeddings").replace("{cosine}", str(COSINE))
MADE_ORACLE = LINKED.replace("{vectors}", MADE_DUCK).replace("{cosine}", str(COSINE))
