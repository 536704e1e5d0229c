"""Automaton, planning, layout: queries that iterate, against unrolled SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import automaton as A
from ..operators import layout as L
from ..operators import planning as P
from ..operators import traversal as T
from ..operators.joins import tested
from ..operators.tables import cut
from .projections import doc_graph, doc_sql, fk_graph, fk_sql
from .registry import query, r6
from .relational import BESIDE, BOTH, CELLS, DEG, DOC, FK, NORM, STEM, torus

SQL = f"WITH {fk_sql()}{BOTH}, adj AS MATERIALIZED (SELECT id, peer, arg_min(relationship, pos) AS rel FROM both_ways GROUP BY id, peer)"

OUT = {
    "proximity": ("ch OR coalesce(nch, false)", "least(1.0, a + CASE WHEN ch THEN 0.5 ELSE 0.2 END)", "true"),
    "damped": ("a > 0.01 OR coalesce(mx > 0.01, false)", "greatest(0.0, least(1.0, a + (0.25 * coalesce(ml, 0) - a) * (1 - st * 0.5)))", "abs({n} - a) >= 0.005"),
    "import": ("coalesce(mx >= {t}, false)", "least(1.0, a * 0.7 + coalesce(ml, 0) * {f} * {d} * 0.3)", "abs({n} - a) >= 0.001"),
    "module": ("coalesce(ni > 0, false)", "least(1.0, a * 0.5 + (0.6 * mi + 0.4 * ai) * 0.5)", "abs({n} - a) >= 0.001"),
    "complexity": ("true", "a", "coalesce(pn <> n OR pi <> im, true)"),
}


def ticks_sql(seed: str, rules: list[str], n: int, f: float = 0.3, t: float = 0.1, d: float = 0.8, until_quiet: int = 0) -> str:
    """s0 is ``seed`` (id, a, ch, st); s1.. follow. pn and pi are the complexity payload's counts.

    until_quiet: after so many ticks, three with few transitions end the run; states stay as they are then (d0, d1.. say so).
    """
    out = f", s0 AS MATERIALIZED (SELECT id, a::DOUBLE AS a, ch, st::DOUBLE AS st, NULL::BIGINT AS pn, NULL::BIGINT AS pi, false AS moved FROM ({seed})), d0 AS (SELECT false AS done)"
    for k in range(n):
        arms = {}
        for r in rules:
            guard, new, moves = (x.replace("{f}", str(f)).replace("{t}", str(t)).replace("{d}", str(d)) for x in OUT[r])
            arms[r] = (guard, new, f"({guard}) AND ({moves.replace('{n}', f'({new})')})")
        case = "CASE WHEN done THEN a " + " ".join(f"WHEN {m} THEN {new}" for _, new, m in arms.values()) + " ELSE a END"
        moved = " OR ".join(f"({m})" for _, _, m in arms.values())
        keep = "false"
        if "complexity" in rules:
            earlier = " OR ".join(f"({arms[r][2]})" for r in rules if r != "complexity") or "false"
            keep = f"NOT done AND NOT ({earlier}) AND {arms['complexity'][2]}"
        out += f""", m{k} AS MATERIALIZED (SELECT adj.id, max(a) AS mx, max(a) FILTER (rel IN ('uses', 'imports', 'contains')) AS ml, max(a) FILTER (rel = 'contains') AS mi, avg(a) FILTER (rel = 'contains') AS ai,
 count(*) FILTER (rel = 'contains') AS ni, count(*) AS n0, count(*) FILTER (rel IN ('uses', 'imports')) AS im0, bool_or(ch) AS nch FROM adj JOIN s{k} ON s{k}.id = peer GROUP BY adj.id),
j{k} AS (SELECT s{k}.*, m{k}.* EXCLUDE (id), coalesce(n0, 0) AS n, coalesce(im0, 0) AS im, done FROM s{k} LEFT JOIN m{k} ON m{k}.id = s{k}.id CROSS JOIN d{k}),
s{k + 1} AS MATERIALIZED (SELECT id, {case} AS a, ch, st, CASE WHEN {keep} THEN n ELSE pn END AS pn, CASE WHEN {keep} THEN im ELSE pi END AS pi, NOT done AND ({moved}) AS moved FROM j{k})"""
        if until_quiet:
            out += f", q{k + 1} AS MATERIALIZED (SELECT count(*) FILTER (moved) / count(*)::DOUBLE AS rate FROM s{k + 1})"
            quiet = " AND ".join(f"(SELECT rate FROM q{k + 1 - i}) < 0.01" for i in range(3)) if k + 1 >= max(3, until_quiet) else "false"
            out += f", d{k + 1} AS MATERIALIZED (SELECT done OR ({quiet}) AS done FROM d{k})"
        else:
            out += f", d{k + 1} AS (SELECT false AS done)"
    return out


#: Ticks after which a run without end is cut off, and those it has at least.
MOST_TICKS, LEAST_TICKS = 30, 3


ROLE = "CASE WHEN kind IN ('Directory', 'Module') THEN 'directory_container' WHEN name IN ('lib.rs', 'main.rs', 'mod.rs') THEN 'entry_point' WHEN norm_in >= 0.5 THEN 'hub' WHEN contains(lower(name), '_utils') THEN 'utility_propagation' WHEN in_degree = 0 THEN 'sink' ELSE 'identity' END"
STABLE = "CASE role WHEN 'entry_point' THEN 1.0 WHEN 'directory_container' THEN 0.8 WHEN 'hub' THEN 0.7 + 0.3 * norm_in WHEN 'utility_propagation' THEN 0.4 + 0.2 * norm_in WHEN 'sink' THEN 0.3 ELSE 0.3 + 0.4 * norm_in END"
TARGET = "CASE role " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.OBJECTIVE.items()) + " ELSE 0.5 END"
ROLES = f"{DEG}{NORM}, roles AS (SELECT nodes.*, in_degree, out_degree, norm_in, {ROLE} AS role FROM nodes JOIN norm USING (id)), des AS (SELECT *, ({STABLE})::DOUBLE AS stability, ({TARGET})::DOUBLE AS target FROM roles), gapped AS (SELECT *, greatest(target - stability, 0) AS gap FROM des), structural AS (SELECT *, gap * (1 + 3 * in_degree / greatest(1, (SELECT max(in_degree) FROM deg))::DOUBLE) AS structural FROM gapped)"


@query("k1_roles", f"{FK}{ROLES} SELECT id, role FROM des")
def _(s, d):
    return P.describe(fk_graph(s, d)).select("id", "role")


@query("k2_stability", f"{FK}{ROLES} SELECT id, round(stability, 6) AS stability FROM des")
def _(s, d):
    return P.describe(fk_graph(s, d)).select("id", r6("stability"))


@query("k8_gaps", f"{FK}{ROLES} SELECT id, round(gap, 6) AS gap FROM gapped")
def _(s, d):
    return P.gaps(P.describe(fk_graph(s, d))).select("id", r6("gap"))


@query("k9_custom_objective", f"{FK}{ROLES} SELECT id, round(greatest(CASE role WHEN 'sink' THEN 0.9 WHEN 'hub' THEN 0.99 ELSE target END - stability, 0), 6) AS gap FROM des")
def _(s, d):
    return P.gaps(P.describe(fk_graph(s, d)), {"sink": 0.9, "hub": 0.99}).select("id", r6("gap"))


ITEMS = f"{ROLES}, tested AS (SELECT DISTINCT dst AS id FROM edges JOIN nodes ON nodes.id = src WHERE kind = 'Test'), items AS (SELECT *, id IN (SELECT id FROM tested) AS has_test FROM structural WHERE gap > 0.001 AND (path LIKE '%.rs' OR kind IN ('Directory', 'Module')))"
ACTION = "CASE WHEN kind IN ('Directory', 'Module') THEN 'review module boundaries and child cohesion' WHEN role = 'utility_propagation' AND NOT has_test THEN 'add unit tests for helper functions' WHEN role = 'utility_propagation' THEN 'document edge cases and invariants' WHEN NOT has_test AND in_degree > 0 THEN 'add tests (other modules depend on this)' WHEN NOT has_test THEN 'add basic test coverage' WHEN in_degree > 3 THEN 'reduce coupling or extract stable interface' ELSE 'improve documentation and error handling' END"


def _structural_items(s, d):
    g = fk_graph(s, d).cut()
    return P.plan_items(P.structural(g).withColumn("propagated", F.lit(0.0)), tested(g)), g


@query("k10_structural_plan", f"{FK}{ITEMS} SELECT id, path, role, round(gap, 6) AS gap, round(structural, 6) AS structural, in_degree, has_test, {ACTION} AS action FROM items ORDER BY round(structural, 9) DESC, round(gap, 9) DESC, in_degree DESC, path, id LIMIT 20")
def _(s, d):
    items, _ = _structural_items(s, d)
    top = items.orderBy(F.desc(F.round("structural", 9)), F.desc(F.round("gap", 9)), F.desc("in_degree"), "path", "id").limit(20)
    return top.select("id", "path", "role", r6("gap"), r6("structural"), "in_degree", "has_test", "action")


@query("c11_suggested_actions", f"{FK}{ITEMS} SELECT id, {ACTION} AS action FROM items")
def _(s, d):
    items, _ = _structural_items(s, d)
    return items.select("id", "action")


@query("f11_plan_summary", f"{FK}{ITEMS}, t AS (SELECT count(*) AS total FROM nodes) SELECT total, total - count(items.id) AS at_target, count(items.id) AS below, round(coalesce(avg(gap), 0), 6) AS avg_gap, round(coalesce(max(gap), 0), 6) AS max_gap, round(1 - coalesce(avg(gap), 0) * count(items.id) / total, 6) AS health FROM t LEFT JOIN items ON true GROUP BY total")
def _(s, d):
    items, g = _structural_items(s, d)
    return P.summary(items, g.nodes.count()).select(F.col("total").cast("long").alias("total"), "at_target", "below", r6("avg_gap"), r6("max_gap"), r6("health"))


@query("k14_quality", f"{FK}{ITEMS}, t AS (SELECT count(*) AS total FROM nodes), q AS (SELECT total, count(items.id) AS below, coalesce(avg(gap), 0) AS ag, coalesce(max(gap), 0) AS mg, count(*) FILTER (role IN ('entry_point', 'hub') AND NOT has_test) AS un FROM t LEFT JOIN items ON true GROUP BY total), r AS (SELECT *, 1 - ag * below / total AS health, (total - below) / total::DOUBLE AS coverage, ag * below / total AS weighted FROM q), g AS (SELECT *, health >= 0.85 AND coverage >= 0.85 AND weighted <= 0.05 AND mg <= 0.15 AND un = 0 AS all_passed FROM r) SELECT round(health, 6) AS health, round(coverage, 6) AS coverage, round(weighted, 6) AS weighted_gap, round(mg, 6) AS max_gap, all_passed, CASE WHEN all_passed THEN 'Strong' WHEN health >= 0.85 AND coverage >= 0.85 THEN 'Acceptable' ELSE 'NeedsAttention' END AS status FROM g")
def _(s, d):
    items, g = _structural_items(s, d)
    return P.quality(items, g.nodes.count()).select(r6("health"), r6("coverage"), r6("weighted_gap"), r6("max_gap"), "all_passed", "status")


@query("g9_quick_wins", f"{FK}{ITEMS} SELECT id, round(gap, 6) AS gap FROM items WHERE gap < 0.15 AND in_degree > 0 ORDER BY 0.6 * structural DESC, gap DESC, in_degree DESC, path, id LIMIT 5")
def _(s, d):
    items, _ = _structural_items(s, d)
    return P.quick_wins(items).select("id", r6("gap"))


@query("f23_contracts", f"{FK}{ROLES} SELECT role, count(*) AS n, round(min(stability), 6) AS low, round(max(stability), 6) AS high FROM des GROUP BY role")
def _(s, d):
    return P.contracts(P.describe(fk_graph(s, d))).select("role", "n", r6("low"), r6("high"))


SEED = "SELECT id, CASE WHEN id % 37 = 0 THEN 1.0 ELSE 0.0 END AS a, id % 37 = 0 AS ch, 0.0 AS st FROM nodes"


def seeded_ids():
    return F.col("id") % 37 == 0


GOAL = "implement part_1 and the supplier cache"


def _seeded(s, d, rules, **k):
    g = fk_graph(s, d).cut()
    return A.Automaton(g, rules, A.initial_state(g.nodes, F.when(seeded_ids(), 1.0).otherwise(0.0), seeded_ids()), **k)


def _activations(run):
    return run.state.select("id", r6("activation"))


@query("j19_change_explorer", f"{SQL}{ticks_sql(SEED, ['proximity', 'import', 'module'], 3)} SELECT id, round(a, 6) AS activation FROM s3")
def _(s, d):
    return _activations(_seeded(s, d, A.default_rules()).run_ticks(3))


@query("j20_impact_analyzer", f"{SQL}{ticks_sql(SEED, ['import', 'module'], 3, 0.5, 0.05, 0.9)} SELECT id, round(a, 6) AS activation FROM s3")
def _(s, d):
    return _activations(_seeded(s, d, A.Registry(A.ImportPropagation(0.5, 0.05, 0.9), A.ModuleActivation())).run_ticks(3))


for _id, _rule, _class in (("j8_import", "import", A.ImportPropagation), ("j9_module", "module", A.ModuleActivation), ("j10_proximity", "proximity", A.ChangeProximity), ("j12_damped", "damped", A.DampedPropagation)):

    def _one(s, d, c=_class):
        return _activations(_seeded(s, d, A.Registry(c())).run_ticks(2))

    query(f"{_id}_rule", f"{SQL}{ticks_sql(SEED, [_rule], 2)} SELECT id, round(a, 6) AS activation FROM s2")(_one)


@query("j11_complexity_rule", f"{SQL}{ticks_sql(SEED, ['complexity'], 1)} SELECT id, pn AS neighbor_count, pi AS import_count, round(least(1.0, 0.1 * pn + 0.2 * pi)::DOUBLE, 6) AS complexity FROM s1")
def _(s, d):
    st = _seeded(s, d, A.Registry(A.ComplexityTracking())).run_ticks(1).state
    return st.select("id", F.col("payload.neighbor_count").alias("neighbor_count"), F.col("payload.import_count").alias("import_count"), F.round("payload.complexity", 6).alias("complexity"))


DESCRIBED = f"SELECT id, CASE WHEN id % 37 = 0 THEN 1.0 ELSE stability * 0.05 END AS a, id % 37 = 0 AS ch, stability AS st FROM des"
FULL = ["proximity", "damped", "import", "module", "complexity"]


RAN = f"{SQL}{ROLES}{ticks_sql(DESCRIBED, FULL, MOST_TICKS, until_quiet=LEAST_TICKS)}"


@query("j21_apply_description", f"{RAN} SELECT id, round(a, 6) AS activation, pn AS neighbor_count, pi AS import_count FROM s{MOST_TICKS}")
def _(s, d):
    g = fk_graph(s, d).cut()
    st = A.with_description(g, P.describe(g), g.nodes.where(seeded_ids())).run().state
    return st.select("id", r6("activation"), F.col("payload.neighbor_count").alias("neighbor_count"), F.col("payload.import_count").alias("import_count"))


@query("j22_impact_report", f"{RAN}, r AS (SELECT id, path, role, round(stability, 6) AS stability, a FROM s{MOST_TICKS} JOIN des USING (id)) SELECT id, path, role, stability, round(a, 6) AS activation, CASE WHEN a >= 0.7 THEN 'High' WHEN a >= 0.3 THEN 'Medium' WHEN a >= 0.05 THEN 'Low' ELSE 'None' END AS level FROM r")
def _(s, d):
    g = fk_graph(s, d).cut()
    desc = cut(P.describe(g))
    r = P.impact_report(desc, A.with_description(g, desc, g.nodes.where(seeded_ids())).run().state)
    return r.select("id", "path", "role", r6("stability"), r6("activation"), "level")


@query("f10_impact_stats", f"{RAN} SELECT count(*) FILTER (a >= 0.7) AS high, count(*) FILTER (a >= 0.3 AND a < 0.7) AS medium, count(*) FILTER (a >= 0.05 AND a < 0.3) AS low, count(*) FILTER (a < 0.05) AS none, round(avg(a), 6) AS avg_activation FROM s{MOST_TICKS}")
def _(s, d):
    g = fk_graph(s, d).cut()
    desc = cut(P.describe(g))
    return P.impact_stats(P.impact_report(desc, A.with_description(g, desc, g.nodes.where(seeded_ids())).run().state)).select("high", "medium", "low", "none", r6("avg_activation"))


@query("g1_top_activated", f"{SQL}{ticks_sql(SEED, ['proximity', 'import', 'module'], 2)} SELECT id, round(a, 6) AS activation FROM s2 ORDER BY a DESC, id LIMIT 25")
def _(s, d):
    return A.top_activated(_seeded(s, d, A.default_rules()).run_ticks(2).state, 25).select("id", r6("activation"))


@query("d3_hot_nodes", f"{SQL}{ticks_sql(SEED, ['proximity', 'import', 'module'], 2)} SELECT id FROM s2 WHERE a >= 0.25")
def _(s, d):
    return A.hot(_seeded(s, d, A.default_rules()).run_ticks(2).state, 0.25).select("id")


@query("d4_active_neighbors", f"{SQL} SELECT id, peer FROM adj WHERE peer % 37 = 0")
def _(s, d):
    run = _seeded(s, d, A.default_rules())
    return A.active_neighbors(run.adjacency, run.state, 0.5).select("id", "peer")


@query("f14_neighbor_means", f"{SQL} SELECT nodes.id, round(coalesce(avg(CASE WHEN peer % 37 = 0 THEN 1.0 ELSE 0.0 END), 0), 6) AS avg_activation FROM nodes LEFT JOIN adj ON adj.id = nodes.id GROUP BY nodes.id")
def _(s, d):
    run = _seeded(s, d, A.default_rules())
    return A.neighbor_means(run.adjacency, run.state).select("id", r6("avg_activation"))


@query("f13_tick_history", f"{SQL}{ticks_sql(SEED, ['proximity', 'import', 'module'], 2)} SELECT 1 AS tick, count(*) FILTER (moved) AS transitions, count(*) FILTER (NOT moved) AS skipped, round(avg(a), 6) AS avg_activation FROM s1 UNION ALL SELECT 2, count(*) FILTER (moved), count(*) FILTER (NOT moved), round(avg(a), 6) FROM s2")
def _(s, d):
    return _seeded(s, d, A.default_rules()).run_ticks(2).ticks().select("tick", "transitions", "skipped", r6("avg_activation"))


def _history_sql(n: int) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS tick, count(*) FILTER (moved) AS transitions, count(*) FILTER (NOT moved) AS skipped, 0::BIGINT AS errors, round(avg(a), 6) AS avg_activation FROM s{k} WHERE NOT (SELECT done FROM d{k - 1}) HAVING count(*) > 0" for k in range(1, n + 1))


@query("j2_run_until_stable", f"{SQL}{ticks_sql(SEED, ['proximity', 'import', 'module'], MOST_TICKS, until_quiet=LEAST_TICKS)} {_history_sql(MOST_TICKS)}")
def _(s, d):
    return _seeded(s, d, A.default_rules()).run().ticks().select("tick", "transitions", "skipped", "errors", r6("avg_activation"))


GAP_TICKS = ticks_sql("SELECT id, least(1.0, structural) AS a, false AS ch, stability AS st FROM structural", ["damped", "import", "module"], MOST_TICKS, until_quiet=LEAST_TICKS)


@query("k10_evolution_plan", f"{SQL}{ITEMS}{GAP_TICKS} SELECT items.id, path, round(0.6 * structural + 0.4 * a, 6) AS priority, round(a, 6) AS propagated, {ACTION} AS action FROM items JOIN s{MOST_TICKS} USING (id)")
def _(s, d):
    return P.evolution_plan(fk_graph(s, d).cut()).select("id", "path", r6("priority"), r6("propagated"), "action")


@query("k10_goal_plan", f"{SQL}{ITEMS}{GAP_TICKS}, g AS (SELECT items.*, a, contains(path, 'part_1') OR contains(path, 'supplier') OR contains(path, 'cache') AS hit FROM items JOIN s{MOST_TICKS} USING (id)) SELECT id, round((0.6 * structural + 0.4 * a) * CASE WHEN hit THEN 3 ELSE 1 END, 6) AS priority, CASE WHEN hit THEN '{GOAL} (goal-directed)' ELSE {ACTION} END AS action FROM g")
def _(s, d):
    return P.evolution_plan(fk_graph(s, d).cut(), goal=GOAL).select("id", r6("priority"), "action")


TOP = f"top AS (SELECT *, 0.6 * structural AS priority, {ACTION} AS action FROM items ORDER BY 0.6 * structural DESC, gap DESC, in_degree DESC, path, id LIMIT "
TASK = "CASE WHEN contains(action, 'test') THEN 'AddTests' WHEN contains(action, 'document') THEN 'AddDocs' WHEN contains(action, 'coupling') OR contains(action, 'interface') THEN 'ReduceCoupling' ELSE 'Refactor' END"


@query("k12_next_task", f"{FK}{ITEMS}, {TOP} 1) SELECT id, path, role, action, {TASK} AS task_action, round(gap, 6) AS gap, round(priority, 6) AS priority, (SELECT count(*) FROM (SELECT DISTINCT path, relationship FROM edges JOIN nodes n ON n.id = src WHERE dst = (SELECT id FROM top) LIMIT 10)) AS dependents, (SELECT count(*) FROM (SELECT DISTINCT path, relationship FROM edges JOIN nodes n ON n.id = dst WHERE src = (SELECT id FROM top) LIMIT 10)) AS dependencies FROM top")
def _(s, d):
    items, g = _structural_items(s, d)
    t = P.next_task(items, g).select(F.from_json("task", "id long, path string, role string, action string, task_action string, gap double, priority double, dependents array<string>, dependencies array<string>").alias("t")).select("t.*")
    return t.select("id", "path", "role", "action", "task_action", r6("gap"), r6("priority"), F.size("dependents").cast("long").alias("dependents"), F.size("dependencies").cast("long").alias("dependencies"))


# Migration ranking over the documents

MIG = f"""WITH {doc_sql()}, x AS (SELECT * FROM edges WHERE relationship <> 'contains'), i AS (SELECT dst AS id, count(*) AS n FROM x GROUP BY dst), o AS (SELECT src AS id, count(*) AS n FROM x GROUP BY src),
dg AS (SELECT nodes.*, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM nodes LEFT JOIN i USING (id) LEFT JOIN o USING (id)), mx AS (SELECT greatest(1, max(in_degree)) AS mi, greatest(1, max(out_degree)) AS mo FROM dg),
t AS (SELECT id, path FROM nodes WHERE kind = 'Test'),
c AS (SELECT dg.*, in_degree / mi::DOUBLE AS ni, out_degree / mo::DOUBLE AS no, (id IN (SELECT dst FROM edges JOIN t ON t.id = src) OR EXISTS (SELECT 1 FROM t WHERE contains(t.path, {STEM.replace('path', 'dg.path')}))) AS has_test, contains(path, 'parse') AS cpu, contains(path, 'api') OR contains(path, 'client') OR contains(path, 'db') AS io, contains(path, 'plugin') AS dyn FROM dg, mx WHERE path LIKE '%.py' AND kind <> 'Test'),
sc AS (SELECT *, least(1.0, 0.2 + 0.4 * ni + CASE WHEN has_test THEN 0.15 ELSE 0 END + CASE WHEN cpu THEN 0.25 ELSE 0 END)::DOUBLE AS impact, greatest(0.1, least(1.0, 0.2 + 0.2 * no + CASE WHEN has_test THEN 0 ELSE 0.25 END + CASE WHEN io THEN 0.25 ELSE 0 END + CASE WHEN dyn THEN 0.1 ELSE 0 END))::DOUBLE AS cost FROM c),
fin AS (SELECT *, impact / greatest(cost, 0.1) AS roi, CASE WHEN NOT has_test THEN 'TranspileTestsFirst' WHEN cost >= 0.7 THEN 'Defer' WHEN cpu THEN 'Pyo3ShadowModule' ELSE 'RustHelperModule' END AS strategy FROM sc)"""


@query("k17_migration_candidates", f"{MIG} SELECT id, path, has_test, round(impact, 6) AS impact, round(cost, 6) AS cost, round(roi, 6) AS roi, strategy, concat_ws(', ', CASE WHEN cpu THEN 'CPU-like name/path' END, CASE WHEN in_degree > 0 THEN 'has dependents' END, CASE WHEN has_test THEN 'test signal present' ELSE 'tests should be ported first' END, CASE WHEN strategy = 'Defer' THEN 'high migration cost' END) AS reason FROM fin")
def _(s, d):
    c = P.migration_candidates(doc_graph(s, d))
    return c.select("id", "path", "has_test", r6("impact"), r6("cost"), r6("roi"), "strategy", "reason")


@query("g4_ranked_candidates", f"{MIG} SELECT id, row_number() OVER (ORDER BY round(roi, 9) DESC, round(impact, 9) DESC, round(cost, 9), path) AS rank FROM fin QUALIFY rank <= 50")
def _(s, d):
    c = P.migration_candidates(doc_graph(s, d))
    return P.ranked_candidates(c.withColumns({k: F.round(k, 9) for k in ("roi", "impact", "cost")})).select("id", F.col("rank").cast("long").alias("rank"))


@query("f16_repo_summary", f"{MIG}, f AS (SELECT split_part(path, '/', 1) AS repo, count(*) FILTER (path LIKE '%.py') AS python, count(*) FILTER (path LIKE '%.rs') AS rust, count(*) FILTER (kind = 'Test') AS tests FROM nodes WHERE kind <> 'Directory' GROUP BY 1), b AS (SELECT split_part(path, '/', 1) AS repo, count(*) AS candidates FROM fin GROUP BY 1) SELECT repo, python, rust, tests, coalesce(candidates, 0) AS candidates, CASE WHEN python > 0 AND rust > 0 THEN 'mixed' WHEN python > 0 THEN 'python' WHEN rust > 0 THEN 'rust' ELSE 'other' END AS class FROM f LEFT JOIN b USING (repo)")
def _(s, d):
    g = doc_graph(s, d)
    return P.repo_summary(g, P.migration_candidates(g), F.split_part("path", F.lit("/"), F.lit(1))).drop("top")


# Life on a torus of the suppliers, its cells alive where an error of the events falls

ALIVE = f"{CELLS}, {BESIDE}, hit AS MATERIALIZED (SELECT DISTINCT (event_id * 7 + user_id) % (SELECT count(*) FROM cells) AS id FROM events WHERE event_type = 'error'), s0 AS MATERIALIZED (SELECT id, id IN (SELECT id FROM hit) AS alive FROM cells)"


def living(s, d, g):
    """The torus' state with those cells alive."""
    errors = s.read.parquet(f"{d}/events.parquet").where("event_type = 'error'")
    hit = errors.select(F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(g.nodes.count())).alias("id"))
    return A.seeded(A.marked(A.initial_state(g.nodes), hit), F.col("mine"), 1.0).drop("mine")


def _life_sql(n: int) -> str:
    out = f"WITH {ALIVE}"
    for k in range(n):
        out += f", s{k + 1} AS MATERIALIZED (SELECT s{k}.id, n = 3 OR (s{k}.alive AND n = 2) AS alive FROM s{k} JOIN (SELECT beside.id, count(*) FILTER (alive) AS n FROM beside JOIN s{k} ON s{k}.id = peer GROUP BY beside.id) USING (id))"
    return out + f" SELECT id, alive FROM s{n}"


@query("j16_life", _life_sql(4))
def _(s, d):
    g = torus(s, d)
    run = A.Automaton(g, A.Registry(A.Life()), living(s, d, g)).run_ticks(4)
    return run.state.select("id", (F.col("activation") >= 0.5).alias("alive"))


@query("f27_alive_stats", f"WITH {ALIVE} SELECT count(*) FILTER (alive) AS alive, count(*) FILTER (NOT alive) AS dead, round(avg(alive::INT), 6) AS avg_activation FROM s0")
def _(s, d):
    st = living(s, d, torus(s, d))
    return st.agg(F.count_if(F.col("activation") >= 0.5).alias("alive"), F.count_if(F.col("activation") < 0.5).alias("dead"), r6(F.avg("activation"), "avg_activation"))


# Layout over all nodes, from places made of their ids

PLACES = f"p AS MATERIALIZED (SELECT id, (((id * 37) % 10007 + 10007) % 10007)::DOUBLE AS x, (((id * 53) % 9973 + 9973) % 9973)::DOUBLE AS y FROM nodes)"


def _places(g):
    return g.nodes.select("id", F.pmod(F.col("id") * 37, F.lit(10007)).cast("double").alias("x"), F.pmod(F.col("id") * 53, F.lit(9973)).cast("double").alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))


REPULSE = "rep AS (SELECT id, sum(dx / (sqrt(d2) * d2) * 1000) AS fx, sum(dy / (sqrt(d2) * d2) * 1000) AS fy FROM (SELECT id, dx, dy, dx * dx + dy * dy + 0.01 AS d2 FROM (SELECT a.id, a.x - b.x AS dx, a.y - b.y AS dy FROM own a, p b)) GROUP BY id)"
SPRING = "sp AS (SELECT id, sum(fx) AS px, sum(fy) AS py FROM (SELECT s.id, (t.x - s.x) / d * (d - 50) * 0.01 AS fx, (t.y - s.y) / d * (d - 50) * 0.01 AS fy FROM (SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT dst, src FROM edges WHERE src <> dst) e JOIN p s ON s.id = src JOIN p t ON t.id = dst, LATERAL (SELECT sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + 0.01) AS d)) GROUP BY id)"
MOVED = "SELECT p.id, round(x + 0.9 * 0.016 * 0.016 * (fx + coalesce(px, 0) - x * 0.1), 6) AS x, round(y + 0.9 * 0.016 * 0.016 * (fy + coalesce(py, 0) - y * 0.1), 6) AS y FROM p JOIN rep USING (id) LEFT JOIN sp USING (id)"


def _barnes_hut_sql(depth: int, theta: float) -> str:
    """rep by walking down the levels of the quadtree, all places together."""
    n = 1 << depth
    out = f"box AS MATERIALIZED (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y), 1.0) * 1.1 AS side FROM p), grid AS MATERIALIZED (SELECT id, x, y, least({n - 1}, floor((x - x0) / side * {n}))::BIGINT AS i, least({n - 1}, floor((y - y0) / side * {n}))::BIGINT AS j FROM p, box), f0 AS (SELECT id, x, y, 0::BIGINT AS i, 0::BIGINT AS j FROM p)"
    for level in range(depth + 1):
        shift = depth - level
        near = f"side / {1 << level} / sqrt(d2) >= {theta} AND mass > 1" if level < depth else "false"
        out += f", c{level} AS MATERIALIZED (SELECT i >> {shift} AS i, j >> {shift} AS j, count(*) AS mass, avg(x) AS x, avg(y) AS y FROM grid GROUP BY 1, 2)"
        out += f", w{level} AS MATERIALIZED (SELECT *, {near} AS near FROM (SELECT f.id, f.x, f.y, c.i, c.j, mass, f.x - c.x AS dx, f.y - c.y AS dy, (f.x - c.x) * (f.x - c.x) + (f.y - c.y) * (f.y - c.y) + 0.01 AS d2 FROM f{level} f JOIN c{level} c USING (i, j)), box)"
        out += f", f{level + 1} AS (SELECT id, x, y, 2 * i + a AS i, 2 * j + b AS j FROM w{level}, range(2) r(a), range(2) q(b) WHERE near)"
    every = " UNION ALL ".join(f"SELECT id, dx, dy, d2, mass FROM w{level} WHERE NOT near" for level in range(depth + 1))
    return out + f", rep AS (SELECT id, sum(dx / (sqrt(d2) * d2) * 1000 * mass) AS fx, sum(dy / (sqrt(d2) * d2) * 1000 * mass) AS fy FROM ({every}) GROUP BY id)"


@query("o2_exact_repulsion", f"{FK}, {PLACES}, own AS (SELECT * FROM p WHERE id IN (SELECT id FROM nodes WHERE kind = 'Directory')), {REPULSE} SELECT id, round(fx, 5) AS fx, round(fy, 5) AS fy FROM rep")
def _(s, d):
    """The directories' forces from all nodes."""
    g = fk_graph(s, d)
    at = _places(g)
    return L.exact_repulsion(at, at.join(g.nodes.where("kind = 'Directory'").select("id"), "id", "left_semi"), 1000.0).select("id", F.round("fx", 5).alias("fx"), F.round("fy", 5).alias("fy"))


@query("o4_springs", f"{FK}, {PLACES}, {SPRING} SELECT id, round(px, 6) AS fx, round(py, 6) AS fy FROM sp")
def _(s, d):
    g = fk_graph(s, d).cut()
    return L.springs(_places(g), g.edges, L.Config()).select("id", r6("fx"), r6("fy"))


@query("o5_layout_step", f"{DOC}, {PLACES}, own AS (SELECT * FROM p), {REPULSE}, {SPRING} {MOVED}")
def _(s, d):
    """With the exact forces, on the documents' graph."""
    g = doc_graph(s, d).cut()
    return L.step(_places(g), g.edges, L.Config(barnes_hut=False)).select("id", r6("x"), r6("y"))


@query("o1_quadtree", f"{FK}, {PLACES}, b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y), 1.0) * 1.1 AS side FROM p), c AS (SELECT level, least((1 << level) - 1, floor((x - x0) / side * (1 << level)))::BIGINT AS i, least((1 << level) - 1, floor((y - y0) / side * (1 << level)))::BIGINT AS j, x, y FROM p, b, range(0, 9) l(level)) SELECT level, i, j, count(*) AS mass, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM c GROUP BY level, i, j")
def _(s, d):
    at = _places(fk_graph(s, d))
    b = L.bounds(at).first()
    return L.cells(at, 8, b["side"], b["x0"], b["y0"]).select(F.col("level").cast("long").alias("level"), "i", "j", "mass", r6("x"), r6("y"))


@query("o3_barnes_hut_step", f"{FK}, {PLACES}, {_barnes_hut_sql(12, 0.8)}, {SPRING} {MOVED}")
def _(s, d):
    g = fk_graph(s, d).cut()
    return L.step(_places(g), g.edges).select("id", r6("x"), r6("y"))


def _hundred_steps(n):
    def run(s, d):
        g = T.random_graph(s, n)
        return L.run(L.start(g.nodes), g.edges.where(F.col("pos") < n), L.Config(repulsion=2000.0, attraction=0.005), 100).select("id", r6("x"), r6("y"))

    return run


#: The published layout harness: 100 steps over so many nodes and as many edges.
for _n in (1000, 9000):
    query(f"o8_layout_{_n}", None)(_hundred_steps(_n))


@query("o9_dense_ids", f"{FK} SELECT id, row_number() OVER (ORDER BY id) - 1 AS index FROM nodes")
def _(s, d):
    return L.dense_ids(fk_graph(s, d).nodes).select("id", F.col("index").cast("long").alias("index"))


@query("p103_camera", f"{FK}, {PLACES}, c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM p) SELECT round(cx, 6) AS cx, round(cy, 6) AS cy, round(2.5 * max(sqrt((x - cx) ** 2 + (y - cy) ** 2)), 6) AS radius FROM p, c GROUP BY cx, cy")
def _(s, d):
    return L.camera(_places(fk_graph(s, d))).select(r6("cx"), r6("cy"), r6("radius"))


@query("c12_impact_levels", "SELECT c_custkey, CASE WHEN a >= 0.7 THEN 'High' WHEN a >= 0.3 THEN 'Medium' WHEN a >= 0.05 THEN 'Low' ELSE 'None' END AS level FROM (SELECT c_custkey, (c_custkey % 100) / 100.0::DOUBLE AS a FROM customer)")
def _(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", S.impact_level(F.col("c_custkey") % 100 / 100.0).alias("level"))
