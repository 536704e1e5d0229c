import random
from collections import defaultdict
from hashlib import sha256
from itertools import groupby
from zlib import crc32

import numpy as np
import pytest

from skein.llm import common, merkle, queries, replay, topk


def key(row):
    return str(tuple(row))


# Cascading release


def simulated(rows):
    """Plays each conversation attempt by attempt; rows: (conv_id, turn, text)."""
    out, by_conv = [], defaultdict(list)
    for conv, turn, text in rows:
        by_conv[conv].append((turn is not None, turn, text or ""))
    for conv, turns in by_conv.items():
        turns.sort(key=lambda x: (x[0], x[1] or 0))
        at, done = {}, []
        for p, (_, turn, text) in enumerate(turns):
            h = [crc32(f"{k}:{'' if conv is None else conv}:{'' if turn is None else turn}".encode()) for k in range(9)]
            parent = p - h[0] % 5 if 0 < h[0] % 5 <= p else None
            if parent is not None and at[parent] is None:
                at[p] = None
                done.append([conv, turn, "blocked", 0, None, None, p, text])
                continue
            now = first = max(7 * p, 7 * p if parent is None else at[parent])
            faulty, repaired, at[p] = h[1] % 101 < 50, 7 * p + h[2] % 101, None
            for a in range(1, 7):
                if not faulty or not (now < repaired or h[a + 2] % 3 == 0):
                    at[p] = now
                    break
                if a < 6:
                    now += 10 * 2 ** (a - 1)
            done.append([conv, turn, "dead" if at[p] is None else "delivered", a, first, now, p, text])
        state, no = 0, 0
        for d in sorted(done, key=lambda d: (d[5] or 0, d[6])):
            if d[2] == "delivered":
                no += 1
                state += no * crc32(d[7].encode())
                out.append((*d[:6], no, (state + (1 << 63)) % (1 << 64) - (1 << 63)))
            else:
                out.append((*d[:6], None, None))
    return sorted(out, key=key)


def replayed(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    return sorted(map(tuple, replay.replay(spark, df).collect()), key=key)


def test_replay_over_the_table(spark, sf):
    rows = [tuple(r) for r in common.table(spark, sf, "conversations").select("conv_id", "turn", "text").collect()]
    got = queries.op11_replay(spark, sf)
    assert got.columns == ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]
    assert dict(got.dtypes)["attempts"] == "int" and dict(got.dtypes)["last_at"] == dict(got.dtypes)["state"] == "bigint"
    assert sorted(map(tuple, got.collect()), key=key) == simulated(rows)


def test_replay_of_long_conversations(spark):
    """One conversation over all ranges, turns with gaps and below zero, among short ones."""
    draw = random.Random(3)
    rows = [(7, t, f"text {t}") for t in draw.sample(range(-3000, 9000), 4000)] + [(c, t, None) for c in range(40) for t in range(c % 9) if c != 7]
    draw.shuffle(rows)
    assert replayed(spark, rows) == simulated(rows)


def test_replay_of_odd_turns(spark):
    rows = [(1, 0, "a"), (1, 0, "a"), (1, None, ""), (1, 2, None), (None, 0, "no name"), (None, 1, "x" * 200_000), (2, 5, "é🙂"), (2, 1 << 40, "")]
    assert replayed(spark, rows) == simulated(rows)
    clashing = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "1 AS p", "2 AS part", "3 AS conv", "'x' AS status", "true AS unnamed")
    assert sorted(map(tuple, replay.replay(spark, clashing).collect()), key=key) == simulated(rows)
    assert replayed(spark, []) == []


def test_replay_holds_states_in_64_bits(spark):
    text = next(str(k) for k in range(1000) if crc32(str(k).encode()) > 4_200_000_000)
    rows = [(3, t, text) for t in range(130_000)]
    got = replayed(spark, rows)
    assert got == simulated(rows) and min(r[7] for r in got if r[7] is not None) < 0


# Manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def climbed(nodes):
    """The root of some nodes and each one's siblings by level, (before, after)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            start = place // 16 * 16
            proofs[k].append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + 16])))
            at[k] = place // 16
        nodes = [h(*nodes[s : s + 16]) for s in range(0, len(nodes), 16)]
    return nodes[0], proofs


def hashed(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def listed(rows):
    rows = sorted(rows, key=lambda r: (r.source is not None, (r.source or "").encode(), r.doc_id is not None, r.doc_id or 0, hashed(r, r.text)))
    out, subroots = [], []
    for _, group in groupby(rows, key=lambda r: r.source):
        group = list(group)
        subroot, proofs = climbed([hashed(r, r.text) for r in group])
        subroots.append((subroot, group, proofs))
    if not rows:
        return []
    root, above = climbed([s for s, _, _ in subroots])
    for (subroot, group, proofs), over in zip(subroots, above):
        for r, proof in zip(group, proofs):
            shown = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if r.text is not None and crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id is not None else r.text
            held = hashed(r, shown)
            for before, after in proof + over:
                held = h(before, held, after)
            out.append((r.doc_id, hashed(r, r.text), subroot, root, h(*[b + a for b, a in proof + over]), held, held == root))
    return sorted(out, key=key)


def manifested(spark, df):
    return sorted(map(tuple, merkle.manifest(spark, df, merkle.lowered_fifth()).collect()), key=key)


def test_manifest_over_the_table(spark, sf):
    got = sorted(map(tuple, queries.op12_manifest(spark, sf).collect()), key=key)
    assert got == listed(common.table(spark, sf, "documents").collect()) and {r[-1] for r in got} == {True, False}


def test_manifest_bears_odd_rows(spark, odd_documents, no_documents):
    assert manifested(spark, odd_documents) == listed(odd_documents.collect())
    assert manifested(spark, no_documents) == []
    assert manifested(spark, odd_documents.limit(1)) == listed(odd_documents.limit(1).collect())


@pytest.mark.parametrize("n,sources", [(16, 1), (17, 1), (257, 2), (600, 300), (5000, 17)])
def test_manifest_of_many_shapes(spark, n, sources):
    """Full and broken runs, trees of one to four levels, more sources than a run, a source with most of the rows."""
    draw = random.Random(n)
    rows = [(d, f"Text {d % 50}", "en", None if s == 0 else f"é{s}" if s % 2 else f"s{s}", s) for d in draw.sample(range(10 * n), n) for s in [draw.randrange(sources) * draw.randrange(2) if n == 5000 else draw.randrange(sources)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifested(spark, df) == listed(df.collect())


# Top-k


def ranked(rows, every=100, k=10):
    """rows: (vec_id, vector)."""
    fits = [(v, [int(np.floor(x * 1024.0)) for x in e]) for v, e in rows if v is not None and e is not None and all(x is not None and np.isfinite(x * 1024.0) for x in e)]
    out = []
    for i, (q, a) in enumerate(fits):
        if q % every == 0:
            scores = [(-min(max(sum(x * y for x, y in zip(a, b)), -(1 << 63)), (1 << 63) - 1), v) for j, (v, b) in enumerate(fits) if j != i]
            out += [(q, r, v, -s) for r, (s, v) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def topped(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS shard", "2 AS score", "3 AS home", "4 AS block")
    return sorted(map(tuple, topk.top(spark, df, **how).collect()))


def test_top_over_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in common.table(spark, sf, "embeddings").collect()]
    assert sorted(map(tuple, queries.op13_top(spark, sf).collect())) == ranked(rows)


def test_top_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [0.5]), (7, [0.0, 0.0, 9.0]), (8, [1e200, -1e200]), (9, [1e307, 1.0])]
    rows += [(None, [1.0, 1.0]), (100, [0.0, 0.0]), (200, []), (300, [3.0, -1.0]), (400, [-1e9, 1e9]), (500, [2.0**53, 1.0])] + [(10 + k, [1.0, 2.0]) for k in range(15)]
    assert topped(spark, rows) == ranked(rows)
    assert topped(spark, rows[:1]) == [] == topped(spark, []) and topped(spark, rows, k=2) == ranked(rows, k=2)


@pytest.mark.parametrize("shard,block", [(1 << 15, 1 << 14), (64, 8)])
def test_top_with_ties_over_shards_and_blocks(spark, shard, block, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    draw = np.random.default_rng(5)
    rows = [(int(v), [float(x) for x in draw.integers(-2, 3, 6)]) for v in draw.permutation(1500)]
    assert topped(spark, rows, every=20) == ranked(rows, every=20)


def test_index_proves_its_answer_early():
    """Most rows are ruled out by bounds alone, and never one of the best."""
    draw = np.random.default_rng(1)
    x = draw.normal(size=(6000, 64))
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True))
    shard = topk.Shard(type("Row", (), topk.build(0, np.arange(6000), x)))
    for own in range(0, 6000, 600):
        among = shard.members(x[own], 10, np.arange(6000) != own)
        scores = x @ x[own]
        scores[own] = -np.inf
        best = np.sort(scores)[-10]
        assert len(among) <= 6000 // 16 and set(np.flatnonzero(scores >= best)) <= set(among.tolist())
        rows, found = shard.best(x[own], 10, own)
        assert sorted(found) == sorted(np.sort(scores)[-10:])
