"""Graph documents in pieces and splits, and operators as table functions."""

import json
import os

import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from skein import table_functions
from skein.graph import Graph
from skein.sources.store import read_graph_json, write_graph_json


def test_a_document_is_written_in_pieces_and_read_in_splits(spark, tmp_path):
    n = 4000
    nodes = spark.range(n).selectExpr("id", f"{n} - id AS pos", "concat('n', id) AS name", "'File' AS kind", "concat('a \"quoted\", path/', id) AS path").repartition(7)
    edges = spark.range(3 * n).selectExpr(f"id % {n} AS src", f"(id * 7) % {n} AS dst", "'uses' AS relationship", "id AS pos")
    at = str(tmp_path / "graph.json")
    write_graph_json(Graph(nodes, edges), at)
    write_graph_json(Graph(nodes, edges), at)  # in place of the first
    whole = json.load(open(at))
    assert [x["id"] for x in whole["nodes"]] == list(range(n - 1, -1, -1)) and [x["id"] for x in whole["edges"]] == list(range(3 * n)) and os.listdir(tmp_path) in (["graph.json"], [".graph.json.crc", "graph.json"], ["graph.json", ".graph.json.crc"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        back = read_graph_json(spark, at)
        assert back.edges.rdd.getNumPartitions() > 5
        assert [(r.id, r.path) for r in back.nodes.orderBy("pos").collect()] == [(i, f'a "quoted", path/{i}') for i in range(n - 1, -1, -1)]
        assert [(r.src, r.dst) for r in back.edges.orderBy("pos").collect()] == [(k % n, k * 7 % n) for k in range(3 * n)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_documents_of_other_layouts_and_empty_ones(spark, tmp_path):
    at = str(tmp_path / "other.json")
    open(at, "w").write(json.dumps({"nodes": [{"id": 5, "name": "x", "kind": "File", "metadata": {"path": "p/x"}}, {"id": 6, "name": "y", "kind": "File"}], "edges": [{"id": 0, "from": 5, "to": 6, "relationship": "uses"}]}, indent=1))
    g = read_graph_json(spark, at)
    assert [(r.id, r.pos, r.path) for r in g.nodes.orderBy("pos").collect()] == [(5, 0, "p/x"), (6, 1, "y")] and g.edges.count() == 1
    empty = str(tmp_path / "empty.json")
    write_graph_json(Graph(g.nodes.limit(0), g.edges.limit(0)), empty)
    assert json.load(open(empty)) == {"nodes": [], "edges": [], "metadata": {}} and read_graph_json(spark, empty).nodes.count() == 0


def test_regions_are_dealt_out(spark, monkeypatch):
    """A kind's regions go to many partitions of SQL, each region to one: its count is whole."""
    monkeypatch.setattr(table_functions, "SHELF", 10)
    table_functions.register(spark)
    rows = spark.range(400).selectExpr("id", "'x' AS kind", "CASE WHEN id >= 10 THEN concat('a/r', id % 30, '/f', id) WHEN id > 0 THEN '' END AS path")
    dealt = rows.withColumn("shelf", table_functions.shelf(F.col("path"), 2, 400))
    of = {r.region: r for r in dealt.selectExpr("substring_index(coalesce(path, ''), '/', 2) AS region", "shelf").groupBy("region").agg(F.min("shelf").alias("low"), F.max("shelf").alias("high")).collect()}
    assert all(r.low == r.high for r in of.values()) and len({r.low for r in of.values()}) > 10
    got = spark.sql("SELECT * FROM regions(TABLE({t}) PARTITION BY (kind, shelf), depth => 2, by => 'kind')", t=dealt).collect()
    assert sorted(map(tuple, got)) == [("x", "", 10, 0)] + sorted(("x", f"a/r{k}", 13, k if k >= 10 else k + 30) for k in range(30))


def test_table_functions_check_their_input(spark):
    table_functions.register(spark)
    rows = spark.createDataFrame([(1, "a/b/c", "x"), (2, "a/b/d", "x"), (3, "a/e", "y"), (4, None, "y")], "id int, path string, kind string")
    got = spark.sql("SELECT * FROM regions(TABLE({t}) PARTITION BY kind, depth => 2, by => 'kind')", t=rows)
    assert dict(got.dtypes) == {"kind": "string", "region": "string", "n": "bigint", "first_id": "int"}
    assert sorted(map(tuple, got.collect())) == [("x", "a/b", 2, 1), ("y", "", 1, 4), ("y", "a/e", 1, 3)]
    assert sorted(map(tuple, spark.sql("SELECT * FROM regions(TABLE({t}) WITH SINGLE PARTITION)", t=rows).collect())) == [("", 1, 4), ("a", 3, 1)]
    for bad in ("SELECT * FROM regions(TABLE(SELECT 1 AS id))", "SELECT * FROM regions(TABLE(SELECT 1 AS id, 2 AS path))", "SELECT * FROM regions(TABLE(SELECT 1 AS id, 'a' AS path), depth => 0)", "SELECT * FROM regions(TABLE(SELECT 1 AS id, 'a' AS path), by => 'none')", "SELECT * FROM regions('x')", "SELECT * FROM only_changes(TABLE(SELECT 1 AS id))"):
        with pytest.raises((AnalysisException, PythonException)):
            spark.sql(bad).collect()
    keyed = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, None), ("l", 1, "a")], "key string, at int, fingerprint string")
    assert sorted(map(tuple, spark.sql("SELECT * FROM only_changes(TABLE({t}) PARTITION BY key ORDER BY at)", t=keyed).collect()), key=str) == [("k", 1, "a"), ("k", 3, None), ("l", 1, "a")]
