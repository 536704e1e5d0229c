import itertools
import json
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from skein.llm import common, jaccard, langcrf, quality, queries, simhash, toolcalls


def duck(sf, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


# Quality


def test_quality_against_sql(spark, sf):
    con = duck(sf.replace("sf0.001", "sf0.1"), "documents", "labels")
    columns = ("doc_id", *quality.BASE, "base_failed", "kept")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({quality.ORACLE})").fetchall()
    got = sorted(map(tuple, queries.op6_quality(spark, sf.replace("sf0.001", "sf0.1")).select(*columns).collect()))
    assert got == sorted(want)
    assert any(not r[-1] and not r[-2] for r in got)


def test_quality_bears_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 0, "x"), (2, None, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, stratum string")
    rows = quality.judge(spark, odd_documents, labels).collect()
    assert len(rows) == odd_documents.count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_words == by[1].n_words == by[2].n_words == 0 and by[0].base_failed and not by[0].kept
    assert by[8].n_words == 30_000 and by[8].n_repeat_words == 30_000 and by[8].base_failed
    assert quality.judge(spark, no_documents, labels).count() == 0
    assert quality.keep_good(spark, odd_documents, labels.limit(0)).columns == odd_documents.columns


def plain_repeats(words):
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)})


def test_repeat_words_by_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (0, 1, 2, 3, 4, 5, 9, 40, 41)] + ["a a a a", "x y z q x y z", "a\tb\nc  a b\x0bc"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n for r in quality.measured(frame).select("doc_id", "measures.n_repeat_words").toDF("doc_id", "n").collect()}
    assert got == {k: plain_repeats(t.split()) for k, t in enumerate(texts)}


def test_binomial_bound_is_exact(spark):
    import math

    from pyspark.sql import functions as F

    cases = [(0, 100), (3, 500), (40, 2000), (900, 50_000)]
    frame = spark.createDataFrame(cases, "k long, n long")
    for k, n, got in frame.select("k", "n", quality._chance_of_so_few(F.col("k"), F.col("n"), 0.02)).collect():
        terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(0.02) + (n - j) * math.log(0.98) for j in range(k + 1)]
        top = max(terms)
        assert got == pytest.approx(top + math.log(sum(math.exp(t - top) for t in terms)), abs=1e-6)


def test_cutoffs_spare_good_documents(spark):
    """Bad documents stand out by symbols in one stratum; the other has too few labels for any cutoff."""
    rng = np.random.default_rng(4)
    rows = [("a", 1, float(x), 0.05, 0.0, 0.0) for x in rng.uniform(0, 0.01, 3000)] + [("a", 0, float(x), 0.05, 0.0, 0.0) for x in rng.uniform(0.2, 0.5, 300)] + [("b", q, 0.4 * (1 - q), 0.05, 0.0, 0.0) for q in (0, 1) for _ in range(20)]
    frame = spark.createDataFrame(rows, "stratum string, quality int, symbols double, shout double, repeats double, dup_lines double")
    got = {r.stratum: r for r in quality.thresholds(frame).collect()}
    assert set(got) == {"a"} and 0.01 < got["a"].max_symbols < 0.2 and got["a"].max_shout is None


# Language


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    post, pairs = langcrf.forward_backward(e, t, np.asarray([0]), np.asarray([5]), pairs=True)
    want, moves, z = np.zeros((5, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=5):
        w = np.exp(sum(e[k, y] for k, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        z += w
        for k, y in enumerate(path):
            want[k, y] += w
        for a, b in zip(path, path[1:]):
            moves[a, b] += w
    assert np.allclose(post, want / z) and np.allclose(pairs, moves / z)


def test_languages_held_out(spark, sf):
    table = common.table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    rows = [r for r in langcrf.predict(spark, table).collect() if r.held_out]
    assert len(rows) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def plain_language(field, text):
    """Label and score from the learned weights alone: names of features, emissions and chances of all labels word by word."""
    import zlib
    from math import exp, fsum, log

    import regex

    k = len(field.labels)
    total, n = [0.0] * k, 0
    summed = lambda xs: max(xs) + log(fsum(exp(x - max(xs)) for x in xs))
    for line in text.lower().split("\n"):
        words = regex.findall(r"\p{L}+", line)
        for start in range(0, len(words), 256):
            scores = []
            for w in words[start : start + 256]:
                marked = "<" + w + ">"
                names = ["p" + w[:1], "p" + w[:2], "p" + w[:3], "s" + w[-1:], "s" + w[-2:], "s" + w[-3:]]
                names += [marked[a : a + size] for size in (2, 3) for a in range(len(marked) - size + 1)]
                at = [zlib.crc32(x.encode()) % 32768 for x in names]
                known = field.lexicon.get(w, [0.0] * k)
                scores.append([fsum(field.weights[a][y] for a in at) / len(at) + fsum(known[x] * field.entry[x][y] for x in range(k)) for y in range(k)])
            ahead, behind = [scores[0]], [[0.0] * k]
            for s in scores[1:]:
                ahead.append([s[y] + summed([ahead[-1][x] + field.transition[x][y] for x in range(k)]) for y in range(k)])
            for s in reversed(scores[1:]):
                behind.append([summed([field.transition[y][x] + s[x] + behind[-1][x] for x in range(k)]) for y in range(k)])
            for a, b in zip(ahead, reversed(behind)):
                whole = summed([x + y for x, y in zip(a, b)])
                total = [t + exp(x + y - whole) for t, x, y in zip(total, a, b)]
                n += 1
    return (field.labels[total.index(max(total))], max(total) / n) if n else ("und", 0.0)


def test_predictions_by_plain_loops(spark, sf):
    """Documents' languages from the weights, computed apart: short and long texts, with switches, null and without letters."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    field = langcrf.train(docs)
    texts = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(30).collect()]
    words = " ".join(texts).split()
    texts = [t[:1500] for t in texts] + ["", "12 !", "a", "\n\nÀ la\nσΣ", " ".join(words[:700]), "\n".join(words[:60])]
    asked = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = docs.select("doc_id", "text", "lang").unionByName(asked.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    got = {r.doc_id - 10**6: (r.lang_pred, r.score) for r in langcrf.predict(spark, both).where("doc_id >= 1000000").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        label, score = plain_language(field, t)
        assert got[i][0] == label and got[i][1] == pytest.approx(score, abs=1e-9), t[:80]


def test_switched_words_are_labelled(spark, sf):
    table = common.table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    field = langcrf.train(table)
    texts = {y: [r.text for r in table.where(f"lang = '{y}'").orderBy("doc_id").limit(30).collect()] for y in ("en", "de")}
    own = langcrf.Labeller(field)
    right = total = 0
    for a, b in zip(texts["en"], texts["de"]):
        line = " ".join(a.split()[:12] + b.split()[:12])
        words, post, _ = own.posteriors([line.replace("\n", " ")])
        for k, y in enumerate(np.argmax(post, axis=1)):
            if k < 10 or k >= len(words) - 10:
                right, total = right + (field.labels[y] == ("en" if k < 10 else "de")), total + 1
    assert right >= 0.9 * total


def test_languages_bear_odd_rows(spark, odd_documents, no_documents):
    rows = langcrf.predict(spark, odd_documents).collect()
    assert len(rows) == odd_documents.count()
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 3)} == {langcrf.UNKNOWN}
    assert langcrf.predict(spark, no_documents).count() == 0
    assert {r.lang_pred for r in langcrf.predict(spark, odd_documents.where("lang is null")).collect()} == {langcrf.UNKNOWN}
    assert langcrf.keep_known(spark, odd_documents).columns == odd_documents.columns


# Tool calls

SCHEMAS = {"f": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}}, "required": []}, "g": {"type": "object", "required": ["q"], "additionalProperties": False, "properties": {"q": {"type": "string"}}}}


def turn(*calls):
    return " ".join(f"<tool_call>{json.dumps(c)}</tool_call>" for c in calls)


def test_calls_are_linked_ordered_and_checked(spark):
    rows = [
        (1, 0, "assistant", turn({"id": "a", "name": "f", "arguments": {"x": 1.0, "b": {"$result": "b"}}}, {"id": "b", "name": "g", "arguments": {"q": "é"}})),
        (1, 1, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": [2]}})), (1, 2, "tool", '<tool_result>{"id": "a", "content": "done"}</tool_result><tool_result>{"id": "a", "content": "late"}</tool_result>'),
        (2, 0, "assistant", turn({"id": "a", "name": "f", "arguments": {"x": -1}}, {"id": "b", "name": "g", "arguments": {"r": 1}}, {"id": "c", "name": "h", "arguments": {}})), (2, 1, "assistant", "<tool_call>{bad</tool_call>"),
        (3, 0, "assistant", turn({"id": "a", "name": "f", "arguments": {"b": {"$result": "b"}}}, {"id": "b", "name": "f", "arguments": {"b": {"$result": "a"}}})), (4, 0, None, None), (None, None, "user", "x"), (4, 0, None, None),
    ]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, calls string")
    got = {}
    for r in toolcalls.format_turns(spark, frame, SCHEMAS).collect():
        got.setdefault((r.conv_id, r.turn), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    first = json.loads(got[1, 0][0].message)
    assert [(c["id"], c["level"], c["result"]) for c in first["tool_calls"]] == [("b", 0, {"a": [2], "z": 1}), ("a", 1, "done")]
    assert got[1, 0][0].message == toolcalls.canonical(first) and (got[1, 0][0].n_calls, got[1, 0][0].n_linked, got[1, 0][0].n_invalid) == (2, 2, 0)
    assert [c["error"] for c in json.loads(got[2, 0][0].message)["tool_calls"]] == ["$.x: out of range", "$.q: missing", "unknown tool"]
    assert got[2, 1][0].n_invalid == 1 and [c["level"] for c in json.loads(got[3, 0][0].message)["tool_calls"]] == [None, None]
    assert got[4, 0][0].message == '{"content":null,"role":null}'
    assert toolcalls.format_turns(spark, frame.limit(0)).count() == 0


def test_declared_tools_are_schemas(spark):
    declared = [{"name": "f", "parameters": SCHEMAS["f"]}, {"name": "k"}, {"parameters": {}}, 3]
    rows = [
        (1, 0, "system", f"<tools>{json.dumps(declared)}</tools> <tools>[bad</tools>"), (1, 1, "assistant", turn({"id": "a", "name": "f", "arguments": {"x": "1"}}, {"id": "b", "name": "k", "arguments": {"y": 2}}, {"id": "c", "name": "g", "arguments": {"q": "x"}})),
        (2, 0, "assistant", turn({"id": "a", "name": "f", "arguments": {"x": "1"}})), (3, 0, "user", '<tools>{"name": "f", "parameters": {"required": ["x", 7], "properties": 5}}</tools>'), (3, 1, "assistant", turn({"id": "a", "name": "f", "arguments": {"x": 1}})),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    errors = lambda schemas: {(r.conv_id, r.turn): [c["error"] for c in json.loads(r.message)["tool_calls"]] for r in toolcalls.format_turns(spark, frame, schemas).collect() if r.n_calls}
    own = {(1, 1): ["$.x: not integer", None, "unknown tool"], (2, 0): [None], (3, 1): ["$.7: missing"]}
    assert errors(None) == own and errors({"f": {"required": ["z"]}}) == own | {(2, 0): ["$.z: missing"]}


def test_random_calls_against_brute_force(spark):
    """Links, levels (cycles too) and errors of random conversations."""
    rng = random.Random(11)
    rows, talks = [], {}
    for conv in range(60):
        names = [f"c{k}" for k in range(rng.randint(1, 7))]
        calls = [{"id": i, "name": rng.choice("fg"), "arguments": {"n": rng.randint(0, 9), "of": [{"$result": rng.choice(names)} for _ in range(rng.choice([0, 0, 1, 1, 2]))]}} for i in names]
        results = {i: rng.randint(0, 99) for i in names if rng.random() < 0.7}
        tools = [{"name": "f", "parameters": {"properties": {"n": {"maximum": 5}}}}] if rng.random() < 0.5 else []
        rows.append((conv, 0, "system", f"<tools>{json.dumps(tools)}</tools>" if tools else "hello"))
        rows += [(conv, 1 + k, "assistant", turn(c)) for k, c in enumerate(calls)]
        rows += [(conv, 50 + k, "tool", json.dumps({"tool_call_id": i, "content": v})) for k, (i, v) in enumerate(results.items())]
        talks[conv] = (calls, results, tools)
    got = {(r.conv_id, r.turn): json.loads(r.message)["tool_calls"][0] for r in toolcalls.format_turns(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.n_calls}
    cycles = 0
    for conv, (calls, results, tools) in talks.items():
        place = {c["id"]: k for k, c in enumerate(calls)}
        need = {c["id"]: {x["$result"] for x in c["arguments"]["of"]} for c in calls}
        level = {i: 0 for i in place} if all(place[o] < place[i] for i in place for o in need[i]) else {}
        step = 0
        while step == 0 or len(level) < len(place):
            free = [i for i in place if i not in level and all(o in level for o in need[i])]
            if not free:
                break
            level.update(dict.fromkeys(free, step))
            step += 1
        cycles += len(level) < len(place)
        for k, c in enumerate(calls):
            error = None if not tools else "unknown tool" if c["name"] != "f" else "$.n: out of range" if c["arguments"]["n"] > 5 else None
            found = got[conv, 1 + k]
            assert (found["id"], found["level"], found["result"], found["error"]) == (c["id"], level.get(c["id"]), results.get(c["id"]), error)
    assert cycles > 5


def test_canonical_json():
    assert toolcalls.canonical({"b": [1.0, 1.5, None, True], "a": {"é": "\n\"/"}}) == '{"a":{"é":"\\n\\"/"},"b":[1,1.5,null,true]}'
    with pytest.raises(ValueError):
        toolcalls.canonical(float("nan"))


def test_turns_against_sql(spark, sf):
    columns = "conv_id, turn, role, n_calls, n_linked, n_invalid, message"
    want = duck(sf, "conversations").execute(f"SELECT {columns} FROM ({toolcalls.ORACLE})").fetchall()
    assert sorted(map(tuple, queries.op5_tool_calls(spark, sf).select(*columns.split(", ")).collect())) == sorted(want)


def test_made_calls_against_sql(spark, sf):
    columns = "conv_id, turn, n_calls, n_linked, n_invalid, level"
    want = duck(sf, "conversations").execute(f"SELECT {columns} FROM ({toolcalls.MADE_ORACLE})").fetchall()
    got = queries.tool_calls_made(spark, sf).select(*columns.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.n_linked for r in got) > 0 < sum(r.n_invalid for r in got) and len({r.level for r in got}) > 2


# Pipeline


def test_stages_in_turn(spark, sf):
    docs = common.cut(spark, common.table(spark, sf, "documents"), "docs")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(spark, stage(spark, docs, sf), name)
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
        kept.append((docs, out))
        docs = out
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    good = {r.doc_id for r in quality.judge(spark, kept[0][0], common.table(spark, sf, "labels")).where("kept").collect()}
    assert ids(kept[0][1]) == good
    known = {r.doc_id for r in langcrf.predict(spark, kept[1][0]).collect() if r.lang_pred != langcrf.UNKNOWN and r.score >= langcrf.LEAST_SCORE}
    assert ids(kept[1][1]) == known
    texts = {r.doc_id: r.text for r in kept[2][0].collect()}
    sets = {i: jaccard.shingles(t.encode()) for i, t in texts.items()}
    near = {(i, j) for i in texts for j in texts if i < j and jaccard.similar(sets[i], sets[j])}
    left = ids(kept[2][1])
    prints = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(spark, kept[2][0]).collect()}
    near |= {(i, j) for i in texts for j in texts if i < j and (prints[i] ^ prints[j]).bit_count() <= 4}
    assert not any(i in left and j in left for i, j in near) and all(any(gone in pair for pair in near) for gone in texts.keys() - left)
    assert len(left) < len(texts) and {i for i in texts if not any(i in pair for pair in near)} <= left
    assert ids(corpus_pipeline.run(spark, sf)) == ids(docs)


def test_stages_bear_odd_rows(spark, sf, odd_documents, no_documents):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd_documents, sf).collect()
        assert stage(spark, no_documents, sf).count() == 0
    once = corpus_pipeline.near_duplicate_stage(spark, odd_documents, sf)
    assert once.where("doc_id = 5").count() == 1 and once.where("doc_id is null").count() == 1


def copy_with_changes(text, places):
    words = text.split(" ")
    for k in places:
        words[k] = f"changed{k}"
    return " ".join(words)


def test_pipeline_drops_copies_of_similarity_four_fifths(spark, sf):
    """Two changed words in a hundred leave 86 of 106 shingles (0.811), three leave 81 of 111 (0.73)."""
    base = " ".join(f"w{k}" for k in range(100))
    others = [" ".join(f"{name}{k}" for k in range(100)) for name in "abc"]
    rows = [(1, base), (2, copy_with_changes(base, [30, 60])), (3, copy_with_changes(base, [20, 50, 80])), (None, others[0])]
    rows += [(10 + k, t) for k, t in enumerate(others)] + [(20 + k, copy_with_changes(t, [40 + k])) for k, t in enumerate(others)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES[2:-1]:
        docs = stage(spark, docs, sf)
    assert sorted(r.doc_id for r in docs.collect()) == [1, 3, 10, 11, 12]


def test_near_copies_are_those_of_brute_force(spark, sf):
    rows = common.table(spark, sf, "documents").select("text").distinct().limit(150).collect()
    texts = [r.text for r in rows] + [copy_with_changes(r.text, range(3, len(r.text.split(" ")), 60)) for r in rows[:60]]
    sets = [jaccard.shingles(t.encode()) for t in texts]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    id_of = {r.text: r.id for r in frame.select("text", jaccard.text_id().alias("id")).collect()}
    ids = sorted(set(id_of.values()))
    label = {i: i for i in ids}
    near = [(id_of[texts[i]], id_of[texts[j]]) for i in range(len(texts)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    for _ in ids:
        for u, v in near:
            label[u] = label[v] = min(label[u], label[v])
    got = {r.id: r.component for r in jaccard.near_copies(spark, frame).collect()}
    assert len(near) > 10 and {i: got.get(i, i) for i in ids} == label


def test_near_duplicate_stage_judges_rows(spark, sf):
    """A doc_id that names a copy and another text loses the copy only; rows without doc_id are judged like others."""
    one, two, three = (" ".join(f"{name}{k}" for k in range(50)) for name in "xyz")
    rows = [(1, one), (5, one), (5, two), (None, one), (None, three), (None, three)]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf)
    assert sorted(map(tuple, kept.collect()), key=str) == [(1, one), (5, two), (None, three)]
