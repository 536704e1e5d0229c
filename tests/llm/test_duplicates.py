import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from skein.llm import common, pq, queries, simhash
from skein.llm.components import components


def labels_of(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def expected(rows):
    prints = [plain_print(r.text) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    label = labels_of(len(rows), pairs)
    least = {}
    for r, c in zip(rows, label):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    return sorted(((r.doc_id, f"{p:016x}", least.get(c)) for r, p, c in zip(rows, prints, label)), key=str)


def test_simhash_over_the_table(spark, sf):
    rows = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op2_simhash(spark, sf).collect()), key=str) == expected(rows)


def test_simhash_bears_odd_rows(spark, odd_documents, no_documents):
    rows = odd_documents.select("doc_id", "text").where("coalesce(doc_id, 0) <> 8").collect()
    got = simhash.near_duplicates(spark, odd_documents.where("coalesce(doc_id, 0) <> 8"))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    assert simhash.near_duplicates(spark, no_documents).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_trees_join_what_brute_force_joins(spark, hot, monkeypatch):
    """Clouds of near fingerprints, many shards; with ``hot`` shards are dealt by pairs of chunks."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", (200, 200))
    monkeypatch.setattr(simhash, "HOT_ROWS", 300 if hot else 10**9)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 600, dtype=np.uint64)
    near = base[rng.integers(0, 60, 1500)]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    d = simhash.distance(fps[:, None], fps[None, :])
    want = labels_of(len(fps), zip(*np.nonzero(np.triu(d <= 4, 1))))
    distinct = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    got = [(place[r.u], place[r.v]) for r in simhash.links_of(spark, distinct).collect()]
    assert labels_of(len(fps), got) == want


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 200), (200, 300), (300, 100), (7, 7), (None, 3)] + [(1000, k) for k in range(1001, 1050)]
    got = {r.id: r.component for r in components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 300: 100, **{k: 1000 for k in range(1000, 1050)}}
    assert components(spark, spark.createDataFrame([], "u long, v long")).count() == 0


def brute_vectors(rows):
    ok = [r.embedding is not None and len(r.embedding) > 0 and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding) for r in rows]
    sizes = Counter(len(r.embedding) for r, o in zip(rows, ok) if o)
    dim = min(sizes, key=lambda n: (-sizes[n], n)) if sizes else 0
    ok = [o and len(r.embedding) == dim for r, o in zip(rows, ok)]
    x = np.asarray([r.embedding if o else [0.0] * dim for r, o in zip(rows, ok)], float)
    n = np.linalg.norm(x, axis=1)
    cos = (x @ x.T) / np.where(n > 0, n, 1)[:, None] / np.where(n > 0, n, 1)[None, :]
    near = (cos >= 0.95 - 1e-12) & np.outer(ok, ok)
    np.fill_diagonal(near, False)
    label = labels_of(len(rows), zip(*np.nonzero(np.triu(near, 1))))
    least = {}
    for r, c in zip(rows, label):
        least[c] = min(least.get(c, r.vec_id), r.vec_id)
    return sorted((r.vec_id, int(k.sum()), least[c], r.vec_id == least[c]) for r, k, c in zip(rows, near, label))


def test_vectors_over_the_table(spark, sf):
    rows = common.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    assert sorted(map(tuple, queries.op10_pq(spark, sf).collect())) == brute_vectors(rows)


def test_vectors_in_clouds_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(pq, "CHUNK_ROWS", 50)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 24))
    cloud = base[rng.integers(0, 8, 500)] + 0.05 * rng.standard_normal((500, 24))
    x = np.concatenate([base, cloud, cloud[:40], 3 * cloud[:5]])
    frame = spark.createDataFrame([(k, [float(v) for v in row], "x", 0, 1) for k, row in enumerate(x)], "vec_id long, embedding array<float>, label string, node long, n long")
    assert sorted(map(tuple, pq.near_vectors(spark, frame).collect())) == brute_vectors(frame.collect())


def test_vectors_of_any_magnitude(spark):
    """Very small and very large components neither spoil other vectors nor lose links of their own."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 4))
    x = np.concatenate([base[rng.integers(0, 6, 40)] + 0.05 * rng.standard_normal((40, 4)), [[1e-200, 0, 0, 0], [3e-200, 0, 0, 1e-202], [1e200, 1e200, 0, 0], [2e200, 2e200, 0, 0], [1, 1, 0, 0], [5e-324, 0, 0, 0], [1.7e308, 1.7e308, 1.7e308, 1.7e308]]])
    frame = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    scaled = spark.createDataFrame([(k, (row / np.abs(row).max()).tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, pq.near_vectors(spark, frame).collect()))
    assert got == brute_vectors(scaled.collect()) and got[44][1] >= 2 and got[40][1] >= 2


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(8)
    rows = [(k, rng.standard_normal(5).tolist()) for k in range(40)] + [(100 + k, [1.0, k / 100, 0.0]) for k in range(8)] + [(200, [2.0]), (201, [-1.0]), (202, [0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq.near_vectors(spark, frame).collect()}
    assert [got[k] for k in range(100, 108)] == [(7, 100)] * 8 and (got[200], got[201], got[202]) == ((1, 200), (0, 201), (1, 200))


def test_vectors_of_one_hash_are_told_apart(spark):
    """Rows of vectors that only share a hash keep to their own node."""
    rows = spark.createDataFrame([(0, 7, [1.0]), (1, 7, [2.0]), (2, 8, [3.0]), (3, 7, [2.0]), (4, None, None)], "vec_id long, hash long, embedding array<double>")
    nodes = spark.createDataFrame([(10, 7, [1.0]), (11, 7, [2.0]), (12, 8, [3.0])], "node long, hash long, embedding array<double>")
    by_node = spark.createDataFrame([(10, 7, 0, 1), (11, 7, 1, 5), (12, 8, 2, 9)], "node long, hash long, component_id long, n_links long")
    got = {r.vec_id: r.n_links for r in pq._of_rows(spark, rows, nodes, by_node).collect()}
    assert got == {0: 1, 1: 5, 2: 9, 3: 5, 4: None}


def test_vectors_bear_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [0.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, pq.near_vectors(spark, frame).collect())) == brute_vectors(frame.collect())
    assert pq.near_vectors(spark, frame.limit(0)).count() == 0
    assert pq.near_vectors(spark, frame.where("embedding is null")).collect()[0].n_links == 0


def test_odd_vectors_against_sql(spark):
    """The SQL of op10 leaves vectors without links alone as the operator does."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    odd = "(0, [1, 0]), (1, [2, 0]), (2, NULL), (3, []), (4, [0, 0]), (5, ['nan'::FLOAT, 1]), (6, ['inf'::FLOAT, 1]), (7, [NULL, 1]), (8, [1, 0]), (9, [1, 0, 0]), (10, [0, -1])"
    con.execute(f"INSERT INTO embeddings VALUES {odd}")
    frame = spark.createDataFrame(con.execute("SELECT * FROM embeddings").fetchall(), "vec_id long, embedding array<float>")
    got = [tuple(r) for r in pq.near_vectors(spark, frame).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got) == sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({pq.ORACLE})").fetchall())


def test_made_neighbours_against_sql(spark, sf):
    """Links, components and what is kept, where there are some."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = [tuple(r) for r in queries.near_vectors_made(spark, sf).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got) == sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({pq.MADE_ORACLE})").fetchall())
    assert sum(r[1] > 0 for r in got) > len(got) / 2 and any(not r[3] for r in got)
