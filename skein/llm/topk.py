"""Exact top-k by inner product through an impact-ordered index, score at a time.

Vectors are dealt out over shards. A shard's index has, for each dimension, its rows by descending value in posting segments of
one quantised impact each. A query takes the segments of all dimensions by the most that one of their postings can add to a
score, and adds them to accumulators; what a row may still gain is that bound for each of its dimensions not yet met. It stops
once no row outside of a small set can reach the k-th best score known, which is proof, and scores that set exactly; without
proof it goes on to the last posting, after which the accumulators are exact themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE = 1024
#: Rows of a shard and queries of a block, on average; the fewest shards, so that small tables keep all cores busy.
SHARD = 1 << 15
BLOCK = 1 << 14
LEAST_SHARDS = 8
#: Quantised impacts of a dimension.
IMPACTS = 32
#: Shares of a query's postings after which it looks for proof.
LOOKS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 1.0)
#: Sums of this size and over may not be exact as doubles.
EXACT = 1 << 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1

INDEX = "shard int, n int, width int, ids binary, kind string, rows binary, posted binary, starts binary, low binary, high binary"
QUERIES = "home int, place int, query_id long, vector binary"
FOUND = "home int, place int, query_id long, vec_id long, score long"


def _matrix(vectors: list, width: int) -> np.ndarray:
    """floor(1024 x) of each component as doubles, which are whole; shorter vectors are filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = np.floor(np.asarray(v, dtype=float) * SCALE)
    return out


def build(shard: int, ids: np.ndarray, x: np.ndarray) -> dict:
    """A shard's index: its vectors as they are scored, and the postings of each dimension in segments."""
    n, width = x.shape
    posted, starts = np.empty((width, n), "<u4"), np.zeros((width, IMPACTS + 1), "<u4")
    low, high = np.zeros((width, IMPACTS)), np.zeros((width, IMPACTS))
    for d in range(width):
        values = x[:, d]
        order = np.argsort(-values, kind="stable")
        posted[d], ranked = order, values[order]
        step = max((ranked[0] - ranked[-1]) / IMPACTS, 1.0)
        impact = np.minimum((ranked[0] - ranked) // step, IMPACTS - 1)
        starts[d] = np.searchsorted(impact, np.arange(IMPACTS + 1))
        full = starts[d, :-1] < starts[d, 1:]
        high[d, full], low[d, full] = ranked[starts[d, :-1][full]], ranked[starts[d, 1:][full] - 1]
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    parts = {"ids": ids.astype("<i8"), "rows": x.astype(kind), "posted": posted, "starts": starts, "low": low, "high": high}
    return {"shard": shard, "n": n, "width": width, "kind": kind} | {k: v.tobytes() for k, v in parts.items()}


class Shard:
    """A shard's index, read back."""

    def __init__(self, row) -> None:
        n, width = row.n, row.width
        self.shard, self.n = row.shard, n
        self.ids = np.frombuffer(row.ids, "<i8")
        self.rows = np.frombuffer(row.rows, row.kind).reshape(n, width)
        self.posted = np.frombuffer(row.posted, "<u4").reshape(width, n)
        self.starts = np.frombuffer(row.starts, "<u4").reshape(width, IMPACTS + 1).astype(np.int64)
        self.low, self.high = (np.frombuffer(b, "<f8").reshape(width, IMPACTS) for b in (row.low, row.high))
        self.most = float(np.abs(self.rows.astype(float)).max(initial=0))
        self.columns = np.ascontiguousarray(self.rows.T.astype(float))

    def exact(self, q: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Scores of some rows: whole doubles, or Python's own numbers where doubles might not be exact."""
        if self.sure(q):
            return self.rows[among].astype(float) @ q
        return np.array([sum(int(a) * int(b) for a, b in zip(row, q)) for row in self.rows[among]], dtype=object)

    def sure(self, q: np.ndarray) -> bool:
        return self.most * float(np.abs(q).max(initial=0)) * max(len(q), 1) < EXACT

    def best(self, q: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, list[int]]:
        """Rows and scores of the k best, ties by id; ``own`` is left out."""
        others = np.arange(self.n) != own
        among = self.members(q, k, others) if self.sure(q) else np.flatnonzero(others)
        scores = [min(max(int(s), LEAST), MOST) for s in self.exact(q, among)]
        by = sorted(range(len(among)), key=lambda i: (-scores[i], self.ids[among[i]]))[:k]
        return among[by], [scores[i] for i in by]

    def members(self, q: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
        """A set of rows that holds the k best, ties of the last included."""
        active = np.flatnonzero(q)
        if not len(active):
            return np.flatnonzero(others)
        # What a posting of each segment adds at most; segments without postings are left out.
        bound = np.maximum(q[active, None] * self.high[active], q[active, None] * self.low[active])
        size = np.diff(self.starts[active], axis=1)
        bound[size == 0] = -np.inf
        order = np.argsort(-bound, axis=None, kind="stable")[: int((size > 0).sum())]
        bounds, dims, reached = bound.ravel()[order], order // IMPACTS, np.cumsum(size.ravel()[order])
        # A dimension's segments come from one end of it to the other.
        up, at = q[active] > 0, np.zeros(len(active), np.int64)
        sums, met = np.zeros(self.n), np.zeros(self.n)
        known, done = -np.inf, 0
        for share in LOOKS:
            upto = int(np.searchsorted(reached, share * reached[-1])) + 1 if share < 1 else len(order)
            took = np.bincount(dims[done:upto], weights=size.ravel()[order[done:upto]], minlength=len(active)).astype(np.int64)
            done, rows, adds = upto, [], []
            for i in np.flatnonzero(took):
                span = slice(at[i], at[i] + took[i]) if up[i] else slice(self.n - at[i] - took[i], self.n - at[i])
                rows.append(posted := self.posted[active[i], span])
                adds.append(q[active[i]] * self.columns[active[i]][posted])
            at += took
            if rows:
                touched = np.concatenate(rows)
                sums += np.bincount(touched, weights=np.concatenate(adds), minlength=self.n)
                met += np.bincount(touched, minlength=self.n)
            left = bounds[upto] if upto < len(order) else 0.0
            most = np.where(others, sums + (len(active) - met) * left, -np.inf)
            # The k-th best of some rows is a score that the k-th best of all reaches.
            ahead = np.argpartition(most, -min(4 * k, self.n))[-min(4 * k, self.n) :]
            ahead = ahead[others[ahead]]
            if len(ahead) >= k:
                known = max(known, np.partition(self.exact(q, ahead), -k)[-k])
            possible = np.flatnonzero(others & (most >= known))
            if len(possible) <= max(4 * k, self.n // 16) or upto == len(order):
                break
        return possible


def _index(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    made = build(int(pdf["shard"].iloc[0]), pdf["vec_id"].to_numpy("int64"), _matrix(list(pdf["embedding"]), width))
    return pd.DataFrame([made])


def _queries(pdfs: Iterator[pd.DataFrame], every: int) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        for row in pdf.itertuples():
            ids = np.frombuffer(row.ids, "<i8")
            rows = np.frombuffer(row.rows, row.kind).reshape(row.n, row.width)
            places = np.flatnonzero(ids % every == 0)
            yield pd.DataFrame({"home": row.shard, "place": places, "query_id": ids[places], "vector": [rows[p].astype("<f8").tobytes() for p in places]})


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    one = {k: pdf[k].to_numpy("<i8").tobytes() for k in ("home", "place", "query_id")}
    return pd.DataFrame([{"block": pdf["block"].iloc[0], **one, "vectors": b"".join(pdf["vector"])}])


def _search(pdfs: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        for row in pdf.itertuples():
            shard = Shard(row)
            homes, places, names = (np.frombuffer(b, "<i8") for b in (row.home, row.place, row.query_id))
            vectors = np.frombuffer(row.vectors, "<f8").reshape(len(names), row.width)
            found: list[tuple] = []
            for home, place, name, q in zip(homes, places, names, vectors):
                rows, scores = shard.best(q, k, place if home == shard.shard else -1)
                found += [(home, place, name, shard.ids[r], s) for r, s in zip(rows, scores)]
                if len(found) > 20_000:
                    yield pd.DataFrame(found, columns=["home", "place", "query_id", "vec_id", "score"])
                    found = []
            yield pd.DataFrame(found, columns=["home", "place", "query_id", "vec_id", "score"])


def top(spark: SparkSession, embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The ``k`` rows of the highest score for each row whose vec_id ``every`` divides: query_id, rank, vec_id, score.

    Scores are inner products of floor(1024 x), whole numbers; equal scores are ranked by vec_id. Rows whose vec_id or vector is
    null, or whose components are null, not finite or not finite after scaling, take no part. Of vectors of different length the
    longer one's further components count as zero; an empty vector scores 0. A query's own row is no candidate for it; repeated
    rows are candidates for each other, and each asks for itself. Scores beyond 64 bits are held at the
    nearest number of 64 bits, and tie there. Other
    columns are not read. Without queries or without other rows the result is empty.

    Every shard meets every query, in blocks: the query set is a hundredth of the rows. A shard and a block have a bounded size.
    """
    common.bounded_batches(spark)
    fits = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & F.coalesce(F.abs(x.cast("double") * SCALE) < float("inf"), F.lit(False)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & fits)
    asked = F.count_if(F.col("vec_id") % every == 0)
    n, width, n_queries = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0)), asked).first()
    shards, blocks = max(LEAST_SHARDS, -(-n // SHARD)), max(1, -(-n_queries // BLOCK))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    index = common.cut(spark, dealt.groupBy("shard").applyInPandas(lambda pdf: _index(pdf, width), INDEX), "impacts")

    queries = index.select("shard", "n", "width", "ids", "kind", "rows").mapInPandas(lambda pdfs: _queries(pdfs, every), QUERIES)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("home", "place"), F.lit(blocks)).cast("int"))
    asked = common.cut(spark, queries.groupBy("block").applyInPandas(_block, "block int, home binary, place binary, query_id binary, vectors binary"), "queries")
    with_blocks = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    with_shards = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = with_blocks.hint("merge").join(with_shards, ["shard", "block"])
    found = pairs.mapInPandas(lambda pdfs: _search(pdfs, k), FOUND)
    by_score = Window.partitionBy("home", "place", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: Rows of one vec_id are told apart by their number.
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, 1 + least(len(q.x), len(c.x))), lambda i: q.x[i] * c.x[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
