"""The relational tables seen as graphs. One text serves both engines: Spark binds DataFrames to its names, DuckDB its views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import graph
from ..graph import Graph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FK_NODES = """
SELECT CAST(1000000000 + r_regionkey AS BIGINT) AS id, concat('region_', r_regionkey) AS name, 'Directory' AS kind, concat('region_', r_regionkey) AS path FROM {region}
UNION ALL SELECT CAST(2000000000 + n_nationkey AS BIGINT), concat('nation_', n_nationkey), 'Directory', concat('region_', n_regionkey, '/nation_', n_nationkey) FROM {nation}
UNION ALL SELECT CAST(3000000000 + c_custkey AS BIGINT), concat('customer_', c_custkey, '.rs'), 'File', concat('region_', n_regionkey, '/nation_', c_nationkey, '/customer_', c_custkey, '.rs') FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
UNION ALL SELECT CAST(4000000000 + s_suppkey AS BIGINT), concat('supplier_', s_suppkey, '.rs'), 'File', concat('region_', n_regionkey, '/nation_', s_nationkey, '/supplier_', s_suppkey, '.rs') FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey
UNION ALL SELECT CAST(5000000000 + p_partkey AS BIGINT), CASE WHEN p_partkey % 500 = 0 THEN 'lib.rs' WHEN p_size % 10 = 0 THEN concat('part_', p_partkey, '_utils.rs') ELSE concat('part_', p_partkey, '.rs') END, 'File',
 CASE WHEN p_partkey % 500 = 0 THEN concat('parts/p', p_partkey, '/lib.rs') WHEN p_size % 10 = 0 THEN concat('parts/part_', p_partkey, '_utils.rs') ELSE concat('parts/part_', p_partkey, '.rs') END FROM {part}
UNION ALL SELECT CAST(6000000000 + o_orderkey AS BIGINT), CASE WHEN o_orderkey % 50 = 0 THEN concat('test_order_', o_orderkey, '.rs') ELSE concat('order_', o_orderkey, '.rs') END, CASE WHEN o_orderkey % 50 = 0 THEN 'Test' ELSE 'File' END,
 CASE WHEN o_orderkey % 50 = 0 THEN concat('orders/test_order_', o_orderkey, '.rs') ELSE concat('orders/order_', o_orderkey, '.rs') END FROM {orders}
"""

FK_EDGES = """
SELECT CAST(1000000000 + n_regionkey AS BIGINT) AS src, CAST(2000000000 + n_nationkey AS BIGINT) AS dst, 'contains' AS relationship, 0 AS pos FROM {nation}
UNION ALL SELECT CAST(2000000000 + c_nationkey AS BIGINT), CAST(3000000000 + c_custkey AS BIGINT), 'contains', 0 FROM {customer}
UNION ALL SELECT CAST(2000000000 + s_nationkey AS BIGINT), CAST(4000000000 + s_suppkey AS BIGINT), 'contains', 0 FROM {supplier}
UNION ALL SELECT CAST(6000000000 + o_orderkey AS BIGINT), CAST(3000000000 + o_custkey AS BIGINT), 'uses', 1 FROM {orders}
UNION ALL SELECT DISTINCT CAST(6000000000 + l_orderkey AS BIGINT), CAST(5000000000 + l_partkey AS BIGINT), 'imports', 2 FROM {lineitem}
UNION ALL SELECT DISTINCT CAST(5000000000 + l_partkey AS BIGINT), CAST(4000000000 + l_suppkey AS BIGINT), 'imports', 2 FROM {lineitem}
"""

#: The extension stands for the language; every tenth document is a test, named after the document of a tenth of its id.
DOC_NODES = """
SELECT DISTINCT CAST(-1 - CAST(substr(source, 4) AS BIGINT) AS BIGINT) AS id, source AS name, 'Directory' AS kind, source AS path FROM {documents}
UNION ALL SELECT doc_id, name, kind, concat(source, '/', lang, '/', name) FROM (
 SELECT doc_id, source, lang, CASE WHEN doc_id % 10 = 0 THEN 'Test' ELSE 'File' END AS kind,
  concat(CASE WHEN doc_id % 10 = 0 THEN 'test_doc_' WHEN doc_id % 7 = 0 THEN 'parser_' WHEN doc_id % 11 = 0 THEN 'api_client_' WHEN doc_id % 13 = 0 THEN 'plugin_' ELSE 'doc_' END, CASE WHEN doc_id % 10 = 0 THEN CAST(doc_id / 10 AS BIGINT) ELSE doc_id END, CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.rs' WHEN 'de' THEN '.ts' ELSE '.md' END) AS name
 FROM {documents}) AS d
"""

DOC_EDGES = """
SELECT CAST(-1 - CAST(substr(source, 4) AS BIGINT) AS BIGINT) AS src, doc_id AS dst, 'contains' AS relationship, 0 AS pos FROM {documents}
UNION ALL SELECT doc_id, prev, 'imports', 1 FROM (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM {documents}) AS d WHERE prev IS NOT NULL
"""


def _names(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}


def fk_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers, suppliers, parts and orders, linked by their keys."""
    named = _names(spark, sf_dir, FK_EDGES)
    # Two edges a line at most, and one an order: counted from the footers.
    about = 3 * named["lineitem"].count()
    parts = -(-about // graph.PART)
    if parts > spark.sparkContext.defaultParallelism:
        # As both DISTINCT need them, so that they take this dealing and none of their own, whose parts would grow.
        named["lineitem"] = named["lineitem"].repartition(parts, F.expr("CAST(5000000000 + l_partkey AS BIGINT)"))
    nodes, edges = spark.sql(FK_NODES, **_names(spark, sf_dir, FK_NODES)), spark.sql(FK_EDGES, **named)
    return Graph(nodes.withColumn("pos", nodes.id), edges, lambda: about)


def doc_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Sources and their documents, each importing the one before it in its source."""
    nodes, edges = (spark.sql(t, **_names(spark, sf_dir, t)) for t in (DOC_NODES, DOC_EDGES))
    return Graph(nodes.withColumn("pos", nodes.id), edges)


def twin(text: str) -> str:
    """The text for DuckDB's views."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def fk_sql() -> str:
    return f"nodes AS MATERIALIZED ({twin(FK_NODES)}), edges AS MATERIALIZED ({twin(FK_EDGES)})"


def doc_sql() -> str:
    return f"nodes AS MATERIALIZED ({twin(DOC_NODES)}), edges AS MATERIALIZED ({twin(DOC_EDGES)})"
