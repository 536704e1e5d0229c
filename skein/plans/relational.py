"""Degrees, selectors, joins, aggregates, rankings, sets and traversal over the tables seen as graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import degrees as D
from ..operators import joins as J
from ..operators import search as R
from ..operators import traversal as T
from .projections import doc_graph, doc_sql, fk_graph, fk_sql
from .registry import query, r6

FK, DOC = f"WITH RECURSIVE {fk_sql()}", f"WITH RECURSIVE {doc_sql()}"
DEG = ", ind AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY dst), outd AS (SELECT src AS id, count(*) AS n FROM edges GROUP BY src), deg AS (SELECT nodes.id, coalesce(ind.n, 0)::BIGINT AS in_degree, coalesce(outd.n, 0)::BIGINT AS out_degree FROM nodes LEFT JOIN ind USING (id) LEFT JOIN outd USING (id))"
BOTH = ", both_ways AS (SELECT src AS id, dst AS peer, relationship, pos FROM edges UNION ALL SELECT dst, src, relationship, pos FROM edges WHERE src <> dst)"
REGION, NATION = 1_000_000_000, 2_000_000_000
CUSTOMER, SUPPLIER, PART = 3_000_000_000, 4_000_000_000, 5_000_000_000

# Nodes, edges, counts


@query("p51_graph_nodes", f"{FK} SELECT id, name, kind, path FROM nodes")
def _(s, d):
    return fk_graph(s, d).nodes.select("id", "name", "kind", "path")


@query("p53_graph_edges", f"{FK} SELECT src, dst, relationship FROM edges")
def _(s, d):
    return fk_graph(s, d).edges.select("src", "dst", "relationship")


@query("p43_graph_counts", f"{FK} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count")
def _(s, d):
    return D.graph_counts(fk_graph(s, d))


@query("e1_clean_edges", f"{FK} SELECT src, dst, relationship FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)")
def _(s, d):
    return fk_graph(s, d).clean().edges.select("src", "dst", "relationship")


@query("f1_degrees", f"{FK}{DEG} SELECT id, in_degree, out_degree FROM deg")
def _(s, d):
    return D.degrees(fk_graph(s, d))


NORM = ", norm AS (SELECT id, in_degree, out_degree, CASE WHEN mi > 0 THEN in_degree / mi::DOUBLE ELSE 0 END AS norm_in, CASE WHEN mo > 0 THEN out_degree / mo::DOUBLE ELSE 0 END AS norm_out FROM deg, (SELECT max(in_degree) AS mi, max(out_degree) AS mo FROM deg))"


@query("f2_normalised_degrees", f"{FK}{DEG}{NORM} SELECT id, round(norm_in, 6) AS norm_in, round(norm_out, 6) AS norm_out FROM norm")
def _(s, d):
    return D.normalised(fk_graph(s, d)).select("id", r6("norm_in"), r6("norm_out"))


@query("f3_migration_degrees", f"{FK}, x AS (SELECT * FROM edges WHERE relationship <> 'contains'), a AS (SELECT nodes.id, (SELECT count(*) FROM x WHERE dst = nodes.id) AS in_degree, (SELECT count(*) FROM x WHERE src = nodes.id) AS out_degree FROM nodes) SELECT id, in_degree, out_degree, round(in_degree / greatest(1, (SELECT max(in_degree) FROM a))::DOUBLE, 6) AS norm_in, round(out_degree / greatest(1, (SELECT max(out_degree) FROM a))::DOUBLE, 6) AS norm_out FROM a")
def _(s, d):
    return D.migration_degrees(fk_graph(s, d)).select("id", "in_degree", "out_degree", r6("norm_in"), r6("norm_out"))


@query("f5_degree_json", f"{FK}{DEG} SELECT deg.id, '{{\"in\":' || in_degree || ',\"out\":' || out_degree || ',\"total\":' || (in_degree + out_degree) || '}}' AS artifact FROM deg JOIN nodes USING (id) WHERE kind = 'File'")
def _(s, d):
    return D.degree_json(fk_graph(s, d))


@query("f6_total_degree", f"{FK}{DEG} SELECT id, in_degree + out_degree AS degree FROM deg")
def _(s, d):
    return D.total_degree(fk_graph(s, d))


@query("f7_kind_counts", f"{FK} SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def _(s, d):
    return D.kind_counts(fk_graph(s, d))


@query("f8_count_of_kind", f"{FK} SELECT count(*) FILTER (kind = 'Test') AS n FROM nodes")
def _(s, d):
    return fk_graph(s, d).nodes.agg(F.count_if(F.col("kind") == "Test").alias("n"))


@query("f26_bounding_box", "SELECT min(c_acctbal) AS min_x, max(c_acctbal) AS max_x, round(avg(c_acctbal), 4) AS avg_x, min(c_nationkey) AS min_y, max(c_nationkey) AS max_y FROM customer")
def _(s, d):
    return s.read.parquet(f"{d}/customer.parquet").agg(F.min("c_acctbal").alias("min_x"), F.max("c_acctbal").alias("max_x"), F.round(F.avg("c_acctbal"), 4).alias("avg_x"), F.min("c_nationkey").alias("min_y"), F.max("c_nationkey").alias("max_y"))


@query("g5_hubs", f"{FK}{DEG} SELECT id, in_degree + out_degree AS degree FROM deg ORDER BY degree DESC, id LIMIT 20")
def _(s, d):
    return D.hubs(fk_graph(s, d), 20)


@query("d10_leaves", f"{FK} SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges)")
def _(s, d):
    return D.leaves(fk_graph(s, d)).select("id")


@query("d10_roots", f"{FK} SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM edges)")
def _(s, d):
    return D.roots(fk_graph(s, d)).select("id")


@query("d10_orphans", f"{FK} SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM edges) AND id NOT IN (SELECT src FROM edges)")
def _(s, d):
    return D.orphans(fk_graph(s, d)).select("id")


@query("d11_degree_flags", f"{FK}{DEG}{NORM} SELECT id, in_degree = 0 AND out_degree = 0 AS is_isolated, in_degree = 0 AS is_leaf, norm_in >= 0.5 AS is_hub FROM norm")
def _(s, d):
    return D.degree_flags(fk_graph(s, d))


# Selectors and search


@query("d1_by_kind", f"{FK} SELECT id FROM nodes WHERE kind = 'Directory'")
def _(s, d):
    return R.Selector.by_kind("Directory").matches(fk_graph(s, d).nodes).select("id")


@query("d1_explicit", f"{FK} SELECT id, name FROM nodes WHERE id IN ({REGION}, {NATION + 1}, {PART + 7})")
def _(s, d):
    return R.Selector.explicit([REGION, NATION + 1, PART + 7]).matches(fk_graph(s, d).nodes).select("id", "name")


@query("d5_search_nodes", f"{FK}, m AS (SELECT id, name, path FROM nodes WHERE (contains(lower(name), 'part_1') OR contains(lower(path), 'part_1')) AND kind = 'File' AND path LIKE '%.rs') SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY id LIMIT 20")
def _(s, d):
    return R.search_nodes(fk_graph(s, d).nodes, "Part_1", "file", "rs").select("id", "name", "path", "total")


@query("d6_list_files", f"{FK}, m AS (SELECT id, path FROM nodes WHERE kind <> 'Directory' AND contains(path, 'region_1/') AND path LIKE '%.rs') SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY id LIMIT 20")
def _(s, d):
    return R.list_files(fk_graph(s, d).nodes, "region_1/", "rs").select("id", "path", "total")


@query("d7_find_by_path", f"{FK} SELECT id, path FROM nodes WHERE ends_with(lower(path), 'part_12.rs') ORDER BY path <> 'PART_12.rs', id LIMIT 1")
def _(s, d):
    return R.find_by_path(fk_graph(s, d).nodes, "PART_12.rs").select("id", "path")


@query("d8_find_by_text", f"{FK}, m AS (SELECT id, CASE WHEN lower(name) = 'nation_1' THEN 1.0 WHEN starts_with(lower(name), 'nation_1') THEN 0.9 WHEN contains(lower(name), 'nation_1') THEN 0.7 WHEN contains(lower(path), 'nation_1') THEN 0.5 END::DOUBLE AS score FROM nodes) SELECT id, score FROM m WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 30")
def _(s, d):
    return R.find_by_text(fk_graph(s, d).nodes, "Nation_1").select("id", "score")


@query("d9_find_by_kind", f"{FK} SELECT id FROM nodes WHERE kind = 'Test'")
def _(s, d):
    return fk_graph(s, d).nodes.where("kind = 'Test'").select("id")


@query("d12_python_candidates", f"{DOC} SELECT id, path FROM nodes WHERE path LIKE '%.py' AND kind <> 'Test' AND NOT contains(path, '/test_')")
def _(s, d):
    n = doc_graph(s, d).nodes
    return n.where((S.language("path") == "python") & (F.col("kind") != "Test") & ~S.is_test_path(F.col("path"))).select("id", "path")


@query("d13_actionable_risks", f"{DOC} SELECT id FROM nodes WHERE NOT (path LIKE '%.d.ts' OR contains(path, 'node_modules/') OR contains(path, 'dist/') OR contains(path, 'target/'))")
def _(s, d):
    return doc_graph(s, d).nodes.where(S.is_actionable_risk(F.col("path"))).select("id")


@query("d14_inference_nodes", f"{FK}{DEG} SELECT id, in_degree FROM deg WHERE in_degree >= 3 ORDER BY id LIMIT 50")
def _(s, d):
    return D.degrees(fk_graph(s, d)).where("in_degree >= 3").orderBy("id").limit(50).select("id", "in_degree")


POLYGON = [(0.0, 0.0), (6000.0, 2.0), (4000.0, 12.0), (8000.0, 20.0), (-500.0, 24.0)]


def _polygon_sql(x: str, y: str) -> str:
    arms = [f"(CASE WHEN (({ay} > {y}) <> ({by} > {y})) AND {x} < ({bx} - {ax}) * ({y} - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END)" for (ax, ay), (bx, by) in zip([(float(a), float(b)) for a, b in POLYGON], [POLYGON[-1], *POLYGON[:-1]])]
    return "(" + " + ".join(arms).replace("0.0 -", "0.0::DOUBLE -") + ") % 2 = 1"


@query("d18_point_in_polygon", f"SELECT c_custkey FROM customer WHERE {_polygon_sql('c_acctbal', 'c_nationkey::DOUBLE')}")
def _(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    return c.where(R.in_polygon(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), POLYGON)).select("c_custkey")


LASSO = f"{FK}, inside AS (SELECT 3000000000 + c_custkey AS id FROM customer WHERE {_polygon_sql('c_acctbal', 'c_nationkey::DOUBLE')})"


@query("i6_lasso_edges", f"{LASSO} SELECT src, dst, relationship FROM edges WHERE src IN (SELECT id FROM inside) OR dst IN (SELECT id FROM inside)")
def _(s, d):
    at = s.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") + CUSTOMER).alias("id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return R.lasso(fk_graph(s, d), at, POLYGON).edges.select("src", "dst", "relationship")


# Joins


@query("e2_neighbors", f"{FK} SELECT n.id AS peer, n.name, relationship FROM (SELECT CASE WHEN src = {SUPPLIER} THEN dst ELSE src END AS id, relationship FROM edges WHERE src = {SUPPLIER} OR dst = {SUPPLIER}) e JOIN nodes n USING (id)")
def _(s, d):
    return J.neighbors(fk_graph(s, d), SUPPLIER).select("peer", "name", "relationship")


@query("e3_neighborhood", f"{FK}, st AS (SELECT id, (id % 97) / 97.0::DOUBLE AS activation FROM nodes) SELECT e.id, direction, peer, round(activation, 6) AS activation FROM (SELECT dst AS id, 'in' AS direction, src AS peer FROM edges UNION ALL SELECT src, 'out', dst FROM edges) e JOIN st ON st.id = peer")
def _(s, d):
    g = fk_graph(s, d)
    return J.neighborhood(g, g.nodes.select("id", (F.col("id") % 97 / 97.0).alias("activation"))).select("id", "direction", "peer", r6("activation"))


@query("e4_all_neighbors", f"{FK}{BOTH} SELECT DISTINCT id, peer FROM both_ways")
def _(s, d):
    return J.all_neighbors(fk_graph(s, d))


@query("e4_neighbors_by_relationship", f"{FK}{BOTH} SELECT DISTINCT id, peer FROM both_ways WHERE relationship = 'uses'")
def _(s, d):
    return J.all_neighbors(fk_graph(s, d), "uses")


@query("e5_adjacency", f"{FK}{BOTH} SELECT id, peer, arg_min(relationship, pos) AS relationship FROM both_ways GROUP BY id, peer")
def _(s, d):
    return fk_graph(s, d).adjacency()


@query("e5_find_relationship", f"{FK} SELECT coalesce(arg_min(relationship, pos), 'unknown') AS relationship FROM edges WHERE (src = {REGION} AND dst = {NATION}) OR (src = {NATION} AND dst = {REGION})")
def _(s, d):
    return R.find_relationship(fk_graph(s, d), NATION, REGION)


@query("e8_hierarchy", f"{FK}, p AS (SELECT id, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM nodes) SELECT n.id AS src, p.id AS dst, 'contains' AS relationship FROM p JOIN nodes n ON n.path = p.parent AND n.kind = 'Directory' AND n.id <> p.id")
def _(s, d):
    return J.hierarchy(fk_graph(s, d).nodes)


@query("e9_dependencies", f"{FK} SELECT direction, relationship, n.id, n.path FROM (SELECT 'in' AS direction, relationship, src AS id FROM edges WHERE dst = {PART + 1} UNION ALL SELECT 'out', relationship, dst FROM edges WHERE src = {PART + 1}) e JOIN nodes n USING (id)")
def _(s, d):
    return J.dependencies(fk_graph(s, d), PART + 1).select("direction", "relationship", "id", "path")


CHANGED = ["parts/part_3.rs", "order_5.rs", "deep/region_0/nation_0", "nation_5/customer_5.rs"]


@query("e11_match_changed", f"{FK}, c AS (SELECT unnest({CHANGED}) AS c), hit AS (SELECT id, c, path = c OR name = c AS exact, '/' || path LIKE '%/' || c OR '/' || c LIKE '%/' || path AS ends FROM nodes, c), known AS (SELECT DISTINCT c FROM hit WHERE exact) SELECT DISTINCT id FROM hit WHERE exact OR (ends AND c NOT IN (SELECT c FROM known))")
def _(s, d):
    return J.match_changed(fk_graph(s, d).nodes, s.createDataFrame([(c,) for c in CHANGED], "changed string"))


@query("e13_enrich_hits", f"{FK}, h AS (SELECT id, (id % 1000) / 1000.0::DOUBLE AS score FROM nodes) SELECT id, name, round(score, 6) AS score FROM h JOIN nodes USING (id)")
def _(s, d):
    from ..operators.vectors import enrich

    n = fk_graph(s, d).nodes
    return enrich(n.select("id", (F.col("id") % 1000 / 1000.0).alias("score")), n).select("id", "name", r6("score"))


@query("e14_tested", f"{FK} SELECT DISTINCT dst AS id FROM edges JOIN nodes ON nodes.id = src WHERE kind = 'Test'")
def _(s, d):
    return J.tested(fk_graph(s, d))


STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"


@query("e16_nearby_tests", f"{DOC}, t AS (SELECT id, path FROM nodes WHERE kind = 'Test'), direct AS (SELECT dst AS id, src AS test FROM edges JOIN t ON t.id = src), st AS (SELECT id, {STEM} AS stem FROM nodes WHERE kind <> 'Directory'), byname AS (SELECT st.id, t.id AS test FROM st JOIN t ON contains(t.path, st.stem) AND stem <> '') SELECT DISTINCT id, test FROM (SELECT * FROM direct UNION ALL SELECT * FROM byname)")
def _(s, d):
    return J.nearby_tests(doc_graph(s, d))


@query("e17_related_paths", f"{FK} SELECT DISTINCT path FROM edges JOIN nodes ON id = dst WHERE src = {PART + 2} AND relationship <> 'contains'")
def _(s, d):
    return J.related_paths(fk_graph(s, d), PART + 2)


@query("e18_collect_neighbors", f"{FK} SELECT path, relationship FROM (SELECT path, relationship, min(id) AS first FROM edges JOIN nodes ON id = dst WHERE src = {PART + 2} GROUP BY path, relationship) ORDER BY first LIMIT 10")
def _(s, d):
    return J.collect_neighbors(fk_graph(s, d), PART + 2, True, 10)


@query("e19_longest_prefix", f"{FK}, r AS (SELECT path AS root FROM nodes WHERE kind = 'Directory') SELECT path, max(root) AS root FROM (SELECT n.path, CASE WHEN n.path = r.root OR starts_with(n.path, r.root || '/') THEN r.root END AS root FROM nodes n LEFT JOIN r ON n.path = r.root OR starts_with(n.path, r.root || '/') WHERE n.kind <> 'Directory') GROUP BY path")
def _(s, d):
    n = fk_graph(s, d).nodes
    return J.longest_prefix(n.where("kind <> 'Directory'").select("path").distinct(), n.where("kind = 'Directory'").select(F.col("path").alias("root")))


@query("e24_remap", f"{FK} SELECT src // 10 AS src, dst // 10 AS dst, relationship FROM edges")
def _(s, d):
    g = fk_graph(s, d)
    return J.remap(g.edges.select("src", "dst", "relationship"), g.nodes.select(F.col("id").alias("old"), F.floor(F.col("id") / 10).cast("long").alias("new")))


@query("c47_common_prefix", f"{FK} SELECT CASE WHEN count(DISTINCT string_split(path, '/')[1]) = 1 THEN min(string_split(path, '/')[1]) ELSE '' END AS root FROM nodes WHERE kind = 'Test'")
def _(s, d):
    return J.common_prefix(fk_graph(s, d).nodes.where("kind = 'Test'"))


@query("i2_ancestors", f"{FK}, p AS (SELECT string_split(path, '/') AS parts FROM nodes) SELECT DISTINCT array_to_string(parts[1:n], '/') AS path FROM p, unnest(range(1, len(parts))) AS u(n)")
def _(s, d):
    return J.ancestors(fk_graph(s, d).nodes)


@query("h6_first_by_path", f"{FK} SELECT path, min(id) AS id FROM nodes GROUP BY path")
def _(s, d):
    return R.first_by_path(fk_graph(s, d).nodes).select("path", "id")


@query("h7_first_by_name", f"{FK} SELECT name, min(id) AS id FROM nodes WHERE kind <> 'Directory' GROUP BY name")
def _(s, d):
    return R.first_by_name(fk_graph(s, d).nodes).select("name", "id")


@query("n8_latest_per_key", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return J.last_per_key(e.select("user_id", "event_id", F.struct("ts", "event_id").alias("at")), "user_id", "at").select("user_id", "event_id")


# Traversal and sets

SEEDS = f"SELECT id FROM nodes WHERE id BETWEEN {SUPPLIER} AND {SUPPLIER + 2}"


def _reach(depth: int, forth: str, back: str, where: str = "true") -> str:
    return f", walk(id, depth) AS (SELECT id, 0 FROM ({SEEDS}) UNION SELECT e.{back}, depth + 1 FROM walk JOIN edges e ON e.{forth} = walk.id WHERE depth < {depth} AND {where}), reach AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"


@query("i3_impact", f"{FK}{_reach(2, 'dst', 'src', "e.relationship <> 'contains'")} SELECT r.id, depth, (SELECT count(*) FROM edges WHERE dst = r.id AND relationship <> 'contains') AS in_degree FROM reach r WHERE depth > 0")
def _(s, d):
    g = fk_graph(s, d)
    return T.impact(g, g.nodes.where(F.col("id").between(SUPPLIER, SUPPLIER + 2))).select("id", "depth", "in_degree")


@query("i4_context_edges", f"{FK}{BOTH}, near AS (SELECT {NATION + 3}::BIGINT AS id UNION SELECT peer FROM both_ways WHERE id = {NATION + 3}) SELECT src, dst, relationship FROM edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)")
def _(s, d):
    return T.context(fk_graph(s, d), NATION + 3).edges.select("src", "dst", "relationship")


@query("h1_union_selection", f"{FK}{_reach(2, 'dst', 'src')} SELECT id FROM reach")
def _(s, d):
    g = fk_graph(s, d)
    return T.expand(g, g.nodes.where(F.col("id").between(SUPPLIER, SUPPLIER + 2)), 2)


@query("h2_replace_selection", f"{FK}{_reach(2, 'dst', 'src')} SELECT id FROM reach WHERE depth = 2")
def _(s, d):
    g = fk_graph(s, d)
    return T.expand(g, g.nodes.where(F.col("id").between(SUPPLIER, SUPPLIER + 2)), 2, "replace")


@query("i5_expand_children", f"{FK}, walk(id, depth) AS (SELECT {REGION}::BIGINT, 0 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = walk.id WHERE depth < 2) SELECT DISTINCT id FROM walk")
def _(s, d):
    g = fk_graph(s, d)
    return T.expand(g, g.nodes.where(F.col("id") == REGION), -2)


@query("h3_invert_selection", f"{FK} SELECT id FROM nodes WHERE kind <> 'File'")
def _(s, d):
    n = fk_graph(s, d).nodes
    return T.invert(n, n.where("kind = 'File'"))


def _pagerank_sql(rounds: int) -> str:
    out = f"{FK}, e AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM edges), n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS MATERIALIZED (SELECT id, 1.0 / n AS rank FROM nodes, n)"
    for k in range(rounds):
        out += f", r{k + 1} AS MATERIALIZED (SELECT nodes.id, 0.15 / n + 0.85 * lost / n + 0.85 * coalesce(g, 0) AS rank FROM nodes CROSS JOIN n CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE id NOT IN (SELECT src FROM e)) LEFT JOIN (SELECT dst, sum(rank * share) AS g FROM r{k} JOIN e ON src = id GROUP BY dst) x ON x.dst = nodes.id)"
    return out + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query("i7_pagerank", _pagerank_sql(20))
def _(s, d):
    return T.pagerank(fk_graph(s, d)).select("id", F.round("rank", 9).alias("rank"))


#: A torus of sixteen cells a row and a row for each supplier.
WIDE = 16
CELLS = f"cells AS MATERIALIZED (SELECT y * {WIDE} + x AS id, x, y, h FROM (SELECT x, unnest(range(h)) AS y, h FROM range({WIDE}) a(x), (SELECT count(*) AS h FROM supplier)))"
BESIDE = f"beside AS MATERIALIZED (SELECT id, ((y + j + h) % h) * {WIDE} + (x + i + {WIDE}) % {WIDE} AS peer FROM cells, range(-1, 2) c(i), range(-1, 2) e(j) WHERE i <> 0 OR j <> 0)"


def torus(s, d):
    return T.lattice(s, WIDE, s.read.parquet(f"{d}/supplier.parquet").count())


@query("a35_lattice_edges", f"WITH {CELLS}, {BESIDE} SELECT DISTINCT id AS src, peer AS dst FROM beside WHERE id < peer")
def _(s, d):
    return torus(s, d).edges.select("src", "dst")


def _mixed_sql(x: str, seed: int, name: str) -> str:
    """u4, made of ``x`` step by step as the library's mixed() does."""
    m = T.MODULUS
    u1 = f"((({x} % {m}) + {seed + 1}) * 48271) % {m}"
    return f"LATERAL (SELECT {u1} AS u1) {name}1, LATERAL (SELECT (u1 * (u1 % 9973 + 1) + {x} % {m}) % {m} AS u2) {name}2, LATERAL (SELECT (u2 * 69621) % {m} AS u3) {name}3, LATERAL (SELECT (u3 * (u3 % 7919 + 1) + {seed}) % {m} AS u4) {name}4"


#: As many nodes as there are customers.
SIZE = "size AS (SELECT count(*) AS n FROM customer)"


def _drawn(most: str, seed: int) -> str:
    return f"(SELECT pos, u4 % {most} AS v FROM (SELECT unnest(range(3 * n)) AS pos, n FROM size) r, {_mixed_sql('pos', seed, 'w')})"


@query("a33_random_graph", f"WITH {SIZE} SELECT src, CASE WHEN skip >= src THEN skip + 1 ELSE skip END AS dst FROM (SELECT a.v AS src, b.v AS skip FROM {_drawn('n', 42)} a JOIN {_drawn('(n - 1)', 43)} b USING (pos))")
def _(s, d):
    return T.random_graph(s, s.read.parquet(f"{d}/customer.parquet").count()).edges.select("src", "dst")


@query("a34_scale_free_graph", f"WITH RECURSIVE {SIZE}, h AS MATERIALIZED (SELECT pos, u4 % (2 * greatest(pos, 1)) AS h FROM (SELECT unnest(range(3 * (n - 1))) AS pos FROM size) r, {_mixed_sql('pos', 42, 'w')}), t AS MATERIALIZED (SELECT pos, h // 2 AS ref, CASE WHEN pos = 0 THEN 0 WHEN h % 2 = 0 THEN least(h // 2 // 3 + 1, pos // 3) END AS dst FROM h), walk(e, pos, dst) AS (SELECT pos, ref, dst FROM t UNION ALL SELECT walk.e, t.ref, t.dst FROM walk JOIN t ON t.pos = walk.pos WHERE walk.dst IS NULL) SELECT e // 3 + 1 AS src, dst FROM walk WHERE dst IS NOT NULL AND dst <> e // 3 + 1")
def _(s, d):
    return T.scale_free_graph(s, s.read.parquet(f"{d}/customer.parquet").count(), 3).edges.select("src", "dst")


@query("i8_architect_preserve", f"{FK} SELECT id, 'new/' || path AS path FROM nodes")
def _(s, d):
    return T.architect(fk_graph(s, d), "preserve").nodes.select("id", "path")


@query("i9_architect_flat", f"{FK} SELECT min(id) AS id, 'new/' || name AS path FROM nodes WHERE kind <> 'Directory' GROUP BY name")
def _(s, d):
    return T.architect(fk_graph(s, d), "flat").nodes.select("id", "path")


@query("i10_architect_lattice", f"{FK} SELECT id, id % 16 AS gx, id // 16 AS gy, 'new/row_' || (id // 16) || '/' || name AS path FROM nodes")
def _(s, d):
    return T.architect(fk_graph(s, d), "lattice").nodes.select("id", F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), "path")
