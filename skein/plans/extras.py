"""Three dimensions, user cells, scripts, descriptions."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..api import Graph
from ..functions import logs
from ..operators import automaton as A
from ..operators import layout3d as L3
from ..operators import planning as P
from ..operators import traversal as T
from ..operators.cells import CellSystem
from ..operators.degrees import degrees
from ..operators.layout import Config
from ..sources import scripts
from .iterative import MIG, ROLES, SEED, SQL, seeded_ids, ticks_sql
from .projections import doc_graph, fk_graph
from .registry import query, r6
from .relational import BOTH, DEG, DOC, FK, SUPPLIER
from .surface import shared, table_sql, values

CUBE = f"{DOC}, p AS (SELECT id, ((id * 37) % 10007)::DOUBLE AS x, ((id * 53) % 9973)::DOUBLE AS y, ((id * 29) % 9967)::DOUBLE AS z FROM nodes WHERE id >= 0)"


def _cube(g):
    at = g.nodes.where("id >= 0").select("id", *[F.pmod(F.col("id") * k, F.lit(m)).cast("double").alias(a) for a, k, m in (("x", 37, 10007), ("y", 53, 9973), ("z", 29, 9967))])
    return at.select("*", *[F.lit(0.0).alias(f"v{a}") for a in "xyz"])


@query("o7_octree", f"{CUBE}, b AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z), 1.0) * 1.1 AS side FROM p) SELECT l AS level, floor((x - x0) / side * (1 << l))::BIGINT AS i, floor((y - y0) / side * (1 << l))::BIGINT AS j, floor((z - z0) / side * (1 << l))::BIGINT AS k, count(*) AS mass, round(avg(x), 6) AS x FROM p, b, range(0, 5) t(l) GROUP BY 1, 2, 3, 4")
def _(s, d):
    at = _cube(doc_graph(s, d))
    b = at.agg(*[f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)]).first()
    side = max(*[b[f"max_{a}"] - b[f"min_{a}"] for a in "xyz"], 1.0) * 1.1
    return L3.cells(at, 4, side, tuple(b[f"min_{a}"] for a in "xyz")).select(F.col("level").cast("long").alias("level"), "i", "j", "k", "mass", r6("x"))


PUSH3 = "e AS (SELECT a.id, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) + 0.01 AS d2 FROM p a, p b), rep AS (SELECT id, sum(dx / (sqrt(d2) * d2) * 1000) AS fx, sum(dy / (sqrt(d2) * d2) * 1000) AS fy, sum(dz / (sqrt(d2) * d2) * 1000) AS fz FROM e GROUP BY id)"


@query("o6_repulsion_3d", f"{CUBE}, {PUSH3} SELECT id, round(fx, 5) AS fx, round(fz, 5) AS fz FROM rep")
def _(s, d):
    return L3.repulsion(_cube(doc_graph(s, d)), Config(depth=16), theta=0.0).select("id", F.round("fx", 5).alias("fx"), F.round("fz", 5).alias("fz"))


@query("o6_step_3d", f"{CUBE}, {PUSH3}, q AS (SELECT s.id, t.x - s.x AS dx, t.y - s.y AS dy, t.z - s.z AS dz FROM (SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT dst, src FROM edges WHERE src <> dst) e JOIN p s ON s.id = src JOIN p t ON t.id = dst), sp AS (SELECT id, sum(dx / d * (d - 50) * 0.01) AS px, sum(dy / d * (d - 50) * 0.01) AS py, sum(dz / d * (d - 50) * 0.01) AS pz FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz + 0.01) AS d FROM q) GROUP BY id) SELECT p.id, {', '.join(f'round({a} + 0.9 * 0.016 * 0.016 * (f{a} + coalesce(p{a}, 0) - {a} * 0.1), 6) AS {a}' for a in 'xyz')} FROM p JOIN rep USING (id) LEFT JOIN sp USING (id)")
def _(s, d):
    g = doc_graph(s, d)
    return L3.step(_cube(g), g.edges, Config(theta=0.0, depth=16)).select("id", r6("x"), r6("y"), r6("z"))


def _half_up(cells):
    return cells["activation"] * 0.5 + (cells["total"] / cells["n"].clip(lower=1)) * 0.5


@query("j24_cell_system", f"{FK}{BOTH}, s AS (SELECT id, CASE WHEN id % 37 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS a FROM nodes), m AS (SELECT b.id, count(*) AS n, sum(a) AS total FROM both_ways b JOIN s ON s.id = peer GROUP BY b.id) SELECT s.id, round(a * 0.5 + coalesce(total / n, 0) * 0.5, 6) AS activation FROM s LEFT JOIN m ON m.id = s.id")
def _(s, d):
    g = fk_graph(s, d)
    return CellSystem(g, A.initial_state(g.nodes, F.when(seeded_ids(), 1.0).otherwise(0.0)), _half_up).tick().select("id", r6("activation"))


@query("k25_scripts", table_sql([("good", 0, "hi", True), ("bad", 3, "", False), ("slow", -1, "", False)], "name, exit_code, stdout, success"))
def _(s, d):
    ran = scripts.run_scripts(s, [("good", "printf hi"), ("bad", "exit 3"), ("slow", "sleep 5")], tempfile.gettempdir(), 1.0)
    return ran.select("name", "exit_code", "stdout", logs.success(F.col("exit_code")).alias("success"))


@query("b12_materialised", table_sql([(31,)], "made"))
def _(s, d):
    g = fk_graph(s, d)
    g = Graph(g.nodes.where("kind = 'Directory' or path = 'orders/test_order_0.rs'"), g.edges)
    return values(s, [(scripts.materialise(g, tempfile.mkdtemp(prefix="skein-")),)], "made int")


@query("b13_test_scaffold", table_sql([(True,)], "compiles"))
def _(s, d):
    compile(scripts.test_scaffold("m", ["a", "b"]), "x", "exec")
    return values(s, [(True,)], "compiles boolean")


@query("k4_node_configs", f"{FK}{ROLES} SELECT id, path, kind, round(stability, 6) AS stability, CASE WHEN id % 10 = 0 THEN 'own' ELSE role END AS rule FROM des")
def _(s, d):
    g = fk_graph(s, d)
    return P.node_configs(P.describe(g), g.nodes.where("id % 10 = 0").select("id", F.lit("own").alias("rule"))).select("id", "path", "kind", r6("stability"), "rule")


@query("k5_default_rules", table_sql(sorted(P.DEFAULT_RULES), "role, rule"))
def _(s, d):
    return P.default_rules_table(s)


@query("k6_features", f"{FK}{ROLES} SELECT id, role, in_degree, out_degree, round(norm_in, 6) AS norm_in, name = 'lib.rs' AS entry FROM des")
def _(s, d):
    return P.structural_features(P.describe(fk_graph(s, d)))


@query("g16_visible_rows", f"{SQL}{ticks_sql(SEED, ['proximity', 'import', 'module'], 1)} SELECT id, round(a, 6) AS activation FROM s1 WHERE a >= 0.05 ORDER BY a DESC, id LIMIT 5")
def _(s, d):
    g = fk_graph(s, d)
    run = A.Automaton(g, A.default_rules(), A.initial_state(g.nodes, F.when(seeded_ids(), 1.0).otherwise(0.0), seeded_ids())).run_ticks(1)
    return P.visible_rows(run.state, 0.05, 5).select("id", r6("activation"))


@query("g6_impact_order", f"{FK}, a AS (SELECT DISTINCT src AS id FROM edges WHERE dst BETWEEN {SUPPLIER} AND {SUPPLIER + 1} AND relationship <> 'contains'), r AS (SELECT a.id, (SELECT count(*) FROM edges WHERE dst = a.id AND relationship <> 'contains') AS n FROM a) SELECT id, row_number() OVER (ORDER BY n DESC, id) AS rank FROM r QUALIFY rank <= 20")
def _(s, d):
    from ..operators.joins import ranked

    g = fk_graph(s, d)
    top = T.impact(g, g.nodes.where(F.col("id").between(SUPPLIER, SUPPLIER + 1)), 1).orderBy(F.desc("in_degree"), "pos").limit(20)
    return ranked(top, F.desc("in_degree"), F.asc("pos")).select("id", F.col("rank").cast("long").alias("rank"))


@query("e15_test_signal", f"{MIG} SELECT id, has_test FROM fin")
def _(s, d):
    return P.migration_candidates(doc_graph(s, d)).select("id", "has_test")


@query("e10_report_join", f"{FK}{ROLES} SELECT id, CASE WHEN kind <> 'Test' THEN path ELSE id::VARCHAR END AS path, CASE WHEN kind <> 'Test' THEN role ELSE 'unknown' END AS role FROM des")
def _(s, d):
    g = fk_graph(s, d)
    return P.impact_report(P.describe(g).where("kind <> 'Test'"), A.initial_state(g.nodes)).select("id", "path", "role")


@query("e21_semantic_plan", f"{FK}{ROLES}, i AS (SELECT *, CASE WHEN id % 3 = 0 THEN 0.8 ELSE 0.0 END AS sem FROM structural WHERE gap > 0.001 AND (path LIKE '%.rs' OR kind IN ('Directory', 'Module'))) SELECT id, round(0.6 * structural * CASE WHEN sem > 0.2 THEN 3 * (1 + sem) ELSE 1 END, 6) AS priority FROM i")
def _(s, d):
    g = fk_graph(s, d)
    scored = P.structural(g).withColumn("propagated", F.lit(0.0))
    near = g.nodes.where("id % 3 = 0").select("id", F.lit(0.8).alias("score"))
    return P.plan_items(scored, g.nodes.limit(0).select("id"), goal="zzz", semantic=near).select("id", r6("priority"))


@query("b5_state_round_trip", f"{FK} SELECT id, 0.0::DOUBLE AS activation FROM nodes")
def _(s, d):
    from ..sources.store import Store

    st = Store(s, shared(s, "store"))
    st.snapshot("state", A.initial_state(fk_graph(s, d).nodes))
    return st.load_snapshot("state").select("id", "activation")


@query("i11_architect_modular", f"{FK} SELECT name FROM nodes WHERE kind <> 'Directory' GROUP BY name")
def _(s, d):
    return T.architect(fk_graph(s, d), "modular").nodes.select("name")


@query("g8_most_depended_on", f"{FK}{DEG} SELECT id, in_degree FROM deg ORDER BY in_degree DESC, id LIMIT 15")
def _(s, d):
    return degrees(fk_graph(s, d)).orderBy(F.desc("in_degree"), "id").limit(15).select("id", "in_degree")
