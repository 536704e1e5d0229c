"""Searches through the index against searches over the nodes."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from skein.operators import search as R
from skein.operators.text_index import TextIndex, cover

NODES = "id long, pos long, name string, kind string, path string, relative_path string, gram string, size int, score double"


@pytest.fixture
def index(spark, tmp_path):
    def make(rows):
        return TextIndex.build(spark.createDataFrame(rows, NODES), f"{tmp_path}/{uuid.uuid4().hex}")

    return make


def plain(df, *extra):
    return [tuple(r) for r in df.select("pos", "id", "name", "path", "gram", *extra).collect()]


def random_nodes(n=300):
    draw = random.Random(5)
    text = lambda: None if draw.random() < 0.05 else "".join(draw.choice("aabB._/é\U0001f600\n") for _ in range(draw.choice([0, 1, 2, 3, 5, 9, 30])))
    rows = [(1000 - k, k, text(), draw.choice(["File", "Test", None]), text(), text(), "own", k, 7.0) for k in range(n)]
    rows += [(2000 + k, n + k, "mod.rs", "File", f"p{k}/mod.rs", None, None, None, None) for k in range(n // 2)]
    rows.append((1, 9999, "long", "File", "ab" * 50_000 + "needle", None, None, None, None))
    return draw, rows


def test_index_equals_scan(index):
    draw, rows = random_nodes()
    ix = index(rows)
    texts = [t for r in rows[:300] for t in (r[2], r[4]) if t]
    asked = ["", "a", "ab", "mod.rs", "MOD.RS", "od.", "s/mod", "needle", "nowhere", "aaa", "ababab", "bneedle", "%", "a_b", "\n\U0001f600"]
    for _ in range(12):
        t = draw.choice(texts)
        a = draw.randrange(len(t))
        asked.append(t[a : a + draw.randint(3, 9)])
    for q in asked:
        assert plain(ix.find_by_text(q), "score") == plain(R.find_by_text(ix.nodes, q), "score"), q
        assert plain(ix.search_nodes(q), "total") == plain(R.search_nodes(ix.nodes, q).orderBy("pos"), "total"), q
    for q, kind, extension in [("mod", "file", "rs"), ("aab", "test", None), ("aab", None, "b"), ("mod", "test", None)]:
        assert plain(ix.search_nodes(q, kind, extension), "total") == plain(R.search_nodes(ix.nodes, q, kind, extension).orderBy("pos"), "total"), q


def test_index_of_nothing(index, spark):
    ix = index([])
    assert ix.find_by_text("abc").count() == ix.search_nodes("abc").count() == ix.find_by_text("a").count() == 0
    assert TextIndex(spark, ix.folder).find_by_text("abc").count() == 0
    assert index([(1, 1, None, None, None, None, None, None, None)]).find_by_text("abc").count() == 0


def test_search_reads_few_folders_and_runs(index):
    _, rows = random_nodes()
    ix = index(rows)
    starts = ix.starts("mod.rs")
    plan = starts._jdf.queryExecution().explainString(starts._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [shelf" in plan and "In(gram" in plan and f"{ix.folder}/nodes" not in plan
    read = ix.places.where(F.col("shelf").isin([r.shelf for r in ix.places.where(F.col("gram").isin("mod", ".rs")).select("shelf").distinct().collect()]))
    assert read.select(F.input_file_name()).distinct().count() < len(ix.places.inputFiles())


@pytest.mark.parametrize("text", ["abc", "abcd", "abcdefg", "aaaaaaaaaa"])
def test_covers_hold_all_characters_and_cost_least(text):
    from itertools import combinations

    counts = {text[o : o + 3]: 1 + (o * 7) % 5 for o in range(len(text) - 2)}
    cost = lambda c: sum(counts[text[o : o + 3]] for o in c)
    whole = lambda c: {p for o in c for p in range(o, o + 3)} == set(range(len(text)))
    every = [c for n in range(1, len(text) - 1) for c in combinations(range(len(text) - 2), n) if whole(c)]
    got = cover(text, counts)
    assert whole(got) and cost(got) == min(map(cost, every))
