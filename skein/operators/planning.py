"""Roles, stability, the ranked work plan, quality gates and migration ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..graph import Graph
from .automaton import Automaton, DampedPropagation, ImportPropagation, ModuleActivation, Registry, initial_state
from .degrees import degrees, migration_degrees, normalised
from .joins import tested
from .tables import cut

#: Target stability by role; others have DEFAULT_TARGET.
OBJECTIVE = {"entry_point": 0.95, "hub": 0.85, "directory_container": 0.80, "utility_propagation": 0.60, "identity": 0.50, "sink": 0.30}
DEFAULT_TARGET = 0.50
DAMPING = 0.5


def role(kind: Column, name: Column, in_degree: Column, norm_in: Column) -> Column:
    return (
        F.when(kind.isin("Directory", "Module"), "directory_container").when(S.is_entry_point(name), "entry_point").when(norm_in >= 0.5, "hub")
        .when(S.is_utility(name), "utility_propagation").when(in_degree == 0, "sink").otherwise("identity")
    )


def stability(role: Column, in_degree: Column, out_degree: Column, norm_in: Column) -> Column:
    return (
        F.when(role == "entry_point", 1.0).when(role == "directory_container", 0.8).when(role == "hub", 0.7 + 0.3 * norm_in).when(role == "utility_propagation", 0.4 + 0.2 * norm_in)
        .when(role == "sink", 0.3).when((in_degree == 0) & (out_degree == 0), 0.1).otherwise(0.3 + 0.4 * norm_in)
    )


def describe(g: Graph) -> DataFrame:
    """The description: id, name, kind, path, degrees, role and stability of every node."""
    d = g.nodes.select("id", "name", "kind", "path").join(normalised(g), "id")
    with_role = d.withColumn("role", role(F.col("kind"), F.col("name"), F.col("in_degree"), F.col("norm_in")))
    return with_role.withColumn("stability", stability(F.col("role"), F.col("in_degree"), F.col("out_degree"), F.col("norm_in")))


def target_for(role: Column, objective: dict[str, float] | None = None) -> Column:
    return S.lookup(OBJECTIVE | (objective or {}), role, DEFAULT_TARGET)


def gaps(description: DataFrame, objective: dict[str, float] | None = None) -> DataFrame:
    d = description.withColumn("target", target_for(F.col("role"), objective))
    return d.withColumn("gap", F.greatest(F.col("target") - F.col("stability"), F.lit(0.0)))


def structural(g: Graph, objective: dict[str, float] | None = None) -> DataFrame:
    """Gaps with the structural score: the gap, up to four times as much by in-degree over the largest."""
    d = gaps(describe(g), objective)
    top = F.broadcast(g.edges.groupBy("dst").count().agg(F.greatest(F.coalesce(F.max("count"), F.lit(1)), F.lit(1)).alias("max_in")))
    return d.join(top).withColumn("structural", F.col("gap") * (1 + 3 * F.col("in_degree") / F.col("max_in")))


def plan_items(scored: DataFrame, has_test: DataFrame, goal: str | None = None, targets: list[str] | None = None, boost: float = 3.0, errors: DataFrame | None = None, semantic: DataFrame | None = None) -> DataFrame:
    """The plan's rows, most urgent first.

    scored: structural() with ``propagated``; has_test: ids; errors: script errors (file, message, pos); semantic: id, score.
    """
    s = scored.where((F.col("gap") > 0.001) & (S.is_source_file("path") | F.col("kind").isin("Directory", "Module")))
    s = s.join(has_test.select("id", F.lit(True).alias("__t")), "id", "left").withColumn("has_test", F.coalesce("__t", F.lit(False))).drop("__t")
    s = s.join(semantic.select("id", F.col("score").alias("semantic")), "id", "left").fillna(0.0, ["semantic"]) if semantic is not None else s.withColumn("semantic", F.lit(0.0))
    priority = 0.6 * F.col("structural") + 0.4 * F.col("propagated")
    goal_hit = F.lit(False)
    if goal is not None:
        keyword = S.matches_path(F.col("path"), F.array(*[F.lit(t) for t in targets or []]).cast("array<string>"), S.goal_keywords(F.lit(goal)))
        by_meaning = F.col("semantic") > 0.2
        goal_hit = keyword | by_meaning
        priority = priority * F.when(goal_hit, boost * F.when(by_meaning, 1 + F.least(F.col("semantic"), F.lit(1.0))).otherwise(1.0)).otherwise(1.0)
    if errors is not None:
        s = s.join(first_errors(s.select("id", "path"), errors), "id", "left")
    else:
        s = s.withColumn("error", F.lit(None).cast("string"))
    priority = priority * F.when(F.col("error").isNotNull(), 5.0).otherwise(1.0)
    plain = F.when(F.col("kind").isin("Directory", "Module"), "review module boundaries and child cohesion").otherwise(S.suggest_action(F.col("role"), F.col("gap"), F.col("in_degree"), F.col("has_test")))
    action = F.when(F.col("error").isNotNull(), F.concat(F.lit("fix: "), "error")).when(goal_hit, F.lit(f"{goal} (goal-directed)")).otherwise(plain)
    out = s.withColumn("priority", priority).withColumn("action", action)
    return out.select("id", "path", "role", "kind", "stability", "target", "gap", "priority", "structural", "propagated", "semantic", "in_degree", "has_test", "action")


def in_plan_order(items: DataFrame) -> DataFrame:
    return items.orderBy(F.desc("priority"), F.desc("gap"), F.desc("in_degree"), "path", "id")


def first_errors(paths: DataFrame, errors: DataFrame) -> DataFrame:
    """id and the first error (by pos) whose file holds the path or lies in it, in any case: joined on the file name.

    If one holds the other as whole components their file names are equal, which is the join key.
    """
    last = lambda c: F.lower(F.regexp_extract(c, r"([^/]*)$", 1))
    e = errors.select(F.lower("file").alias("file"), "message", "pos").withColumn("k", last("file"))
    p = paths.select("id", F.lower("path").alias("path")).withColumn("k", last("path"))
    hit = p.join(e, "k").where(F.contains("path", F.col("file")) | F.contains("file", F.col("path")))
    return hit.groupBy("id").agg(F.min_by("message", "pos").alias("error"))


def evolution_plan(g: Graph, objective: dict[str, float] | None = None, inline_tests: DataFrame | None = None, max_ticks: int = 30, ticks: int | None = None, **how) -> DataFrame:
    """Seeds each node by its gap and fan-in, runs the automaton (``ticks`` fixes the number), and ranks the work."""
    # Written once for the seeds and the ranking.
    scored = cut(structural(g, objective))
    state = initial_state(scored, F.col("structural"), stability=F.col("stability"))
    run = Automaton(g, Registry(DampedPropagation(DAMPING), ImportPropagation(), ModuleActivation()), state, max_ticks=max_ticks)
    run = run.run_ticks(ticks) if ticks is not None else run.run()
    scored = scored.join(run.state.select("id", F.col("activation").alias("propagated")), "id")
    return in_plan_order(plan_items(scored, tested(g, inline_tests), **how))


def summary(items: DataFrame, total: int) -> DataFrame:
    """One row over a plan: total, at_target, below, avg_gap, max_gap, health."""
    a = items.agg(F.count(F.lit(1)).alias("below"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("avg_gap"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap"))
    health = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("avg_gap") * F.col("below") / F.lit(float(total)))) if total else F.lit(1.0)
    return a.select(F.lit(total).alias("total"), (F.lit(total) - F.col("below")).alias("at_target"), "below", "avg_gap", "max_gap", health.alias("health"))


def quality(items: DataFrame, total: int, errors: int = 0) -> DataFrame:
    """One row: KPIs, the six gates, all_passed and status."""
    untested = items.where(F.col("role").isin("entry_point", "hub") & ~F.col("has_test")).agg(F.count(F.lit(1)).alias("untested"))
    s = summary(items, total).join(F.broadcast(untested))
    coverage = F.col("at_target") / F.lit(float(total)) if total else F.lit(1.0)
    weighted = F.col("avg_gap") * F.col("below") / F.lit(float(total)) if total else F.lit(0.0)
    k = s.withColumn("coverage", coverage).withColumn("weighted_gap", weighted).withColumn("errors", F.lit(errors))
    gates = {"gate_errors": F.col("errors") == 0, "gate_health": F.col("health") >= 0.85, "gate_coverage": F.col("coverage") >= 0.85, "gate_avg": F.col("weighted_gap") <= 0.05, "gate_max": F.col("max_gap") <= 0.15, "gate_tests": F.col("untested") == 0}
    k = k.withColumns(gates)
    passed = F.lit(True)
    for name in gates:
        passed = passed & F.col(name)
    k = k.withColumn("all_passed", passed)
    return k.withColumn("status", F.when(F.col("errors") > 0, "Blocked").when(F.col("all_passed"), "Strong").when((F.col("health") >= 0.85) & (F.col("coverage") >= 0.85), "Acceptable").otherwise("NeedsAttention"))


def impact_report(description: DataFrame, state: DataFrame) -> DataFrame:
    """id, path, role, stability, activation, level of every node, most active first."""
    d = description.select("id", "path", "role", "stability")
    j = state.select("id", "activation").join(d, "id", "left").select("id", F.coalesce("path", F.col("id").cast("string")).alias("path"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("stability", F.lit(0.0)).alias("stability"), "activation")
    return j.withColumn("level", S.impact_level(F.col("activation"))).orderBy(F.desc("activation"), "id")


def impact_stats(report: DataFrame) -> DataFrame:
    n = lambda level: F.count_if(F.col("level") == level).alias(level.lower())
    return report.agg(n("High"), n("Medium"), n("Low"), n("None"), F.avg("activation").alias("avg_activation"))


def quick_wins(items: DataFrame, most: int = 5) -> DataFrame:
    return in_plan_order(items.where((F.col("gap") < 0.15) & (F.col("in_degree") > 0))).limit(most)


def next_task(items: DataFrame, g: Graph, neighbours: int = 10) -> DataFrame:
    """One row, task: JSON of the most urgent item, its action, its place in the graph and its steps."""
    from .joins import collect_neighbors

    top = in_plan_order(items).limit(1)
    row = top.first()
    if row is None:
        return top.select(F.lit(None).cast("string").alias("task")).limit(0)
    side = lambda out: F.broadcast(collect_neighbors(g, row["id"], out, neighbours).agg(F.sort_array(F.collect_list(F.struct("path", "relationship"))).alias("n")))
    kind = S.task_action(F.col("action"))
    steps = {
        "AddTests": ["read the public functions", "write a test for each behaviour", "run the test suite"], "AddDocs": ["list contracts and invariants", "document them", "review examples"], "ReduceCoupling": ["find callers", "extract an interface", "move callers to it"],
        "GoalDirected": ["restate the goal for this file", "make the change", "run the checks"], "Fix": ["reproduce the error", "fix it", "run the failing script again"], "Refactor": ["find the parts", "simplify them", "run the checks"],
    }
    step = F.element_at(F.create_map(*[x for k, v in steps.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]), kind)
    doc = F.struct("id", "path", "role", "action", kind.alias("task_action"), "stability", "target", "gap", "priority", "in_degree", "has_test", F.col("dependents.n").alias("dependents"), F.col("dependencies.n").alias("dependencies"), step.alias("steps"))
    return top.join(side(False).alias("dependents")).join(side(True).alias("dependencies")).select(F.to_json(doc).alias("task"))


def contracts(description: DataFrame) -> DataFrame:
    """role, n and its paths' least and greatest stability, most frequent first."""
    return description.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.min("stability").alias("low"), F.max("stability").alias("high")).orderBy(F.desc("n"), "role")


# Migration


def has_hint(path: Column, hints) -> Column:
    return S.holds_any(F.lower(path), hints)


def impact_score(path: Column, norm_in: Column, has_test: Column) -> Column:
    s = 0.20 + 0.40 * norm_in + F.when(has_test, 0.15).otherwise(0.0) + F.when(has_hint(path, S.CPU_HINTS), 0.25).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def cost_score(path: Column, norm_out: Column, has_test: Column) -> Column:
    s = 0.20 + 0.20 * norm_out + F.when(has_test, 0.0).otherwise(0.25) + F.when(has_hint(path, S.IO_HINTS), 0.25).otherwise(0.0) + F.when(has_hint(path, S.DYNAMIC_HINTS), 0.10).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), s))


def migration_strategy(path: Column, has_test: Column, cost: Column) -> Column:
    return F.when(~has_test, "TranspileTestsFirst").when(cost >= 0.70, "Defer").when(has_hint(path, S.CPU_HINTS), "Pyo3ShadowModule").otherwise("RustHelperModule")


def migration_reason(path: Column, in_degree: Column, has_test: Column, strategy: Column) -> Column:
    return F.concat_ws(
        ", ", F.when(has_hint(path, S.CPU_HINTS), "CPU-like name/path"), F.when(in_degree > 0, "has dependents"), F.when(has_test, "test signal present").otherwise("tests should be ported first"), F.when(strategy == "Defer", "high migration cost")
    )


def test_signal(g: Graph, nodes: DataFrame) -> DataFrame:
    """Ids of nodes whose metadata says has_tests, with an edge from a test, or whose stem a test's path holds."""
    from .joins import with_tests

    found = with_tests(g, nodes)
    if "metadata" in g.nodes.columns:
        found = found.unionByName(g.nodes.where(F.col("metadata")["has_tests"] == "true").select("id"))
    if "has_tests" in g.nodes.columns:
        found = found.unionByName(g.nodes.where(F.col("has_tests").cast("string") == "true").select("id"))
    return nodes.select("id").join(found, "id", "left_semi")


def migration_candidates(g: Graph) -> DataFrame:
    """Scored Python files that are no tests and no packaging files."""
    own = g.nodes.where((S.language("path") == "python") & (F.col("kind") != "Test") & ~S.is_test_path(F.col("path")) & ~F.col("name").isin("__init__.py", "conftest.py", "setup.py"))
    d = own.select("id", "name", "path").join(migration_degrees(g), "id").join(test_signal(g, own).withColumn("__t", F.lit(True)), "id", "left").withColumn("has_test", F.coalesce("__t", F.lit(False)))
    p, t = F.col("path"), F.col("has_test")
    d = d.withColumn("impact", impact_score(p, F.col("norm_in"), t)).withColumn("cost", cost_score(p, F.col("norm_out"), t))
    d = d.withColumn("roi", F.col("impact") / F.greatest(F.col("cost"), F.lit(0.1))).withColumn("strategy", migration_strategy(p, t, F.col("cost")))
    return d.withColumn("reason", migration_reason(p, F.col("in_degree"), t, F.col("strategy"))).select("id", "path", "in_degree", "out_degree", "has_test", "impact", "cost", "roi", "strategy", "reason")


def ranked_candidates(candidates: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` with their rank; the report's size bounds the numbering."""
    from .joins import ranked

    order = (F.desc("roi"), F.desc("impact"), F.asc("cost"), F.asc("path"))
    return ranked(candidates.orderBy(*order).limit(most), *order)


def repo_summary(g: Graph, candidates: DataFrame, repo: Column) -> DataFrame:
    """By repository: files by language, tests, candidates, the best of them and a class."""
    lang = S.language("path")
    files = g.nodes.where("kind <> 'Directory'").groupBy(repo.alias("repo")).agg(F.count_if(lang == "python").alias("python"), F.count_if(lang == "rust").alias("rust"), F.count_if(F.col("kind") == "Test").alias("tests"))
    best = candidates.groupBy(repo.alias("repo")).agg(F.count(F.lit(1)).alias("candidates"), F.min_by("path", F.struct(-F.col("roi"), -F.col("impact"), F.col("cost"), F.col("path"))).alias("top"))
    kind = F.when((F.col("python") > 0) & (F.col("rust") > 0), "mixed").when(F.col("python") > 0, "python").when(F.col("rust") > 0, "rust").otherwise("other")
    return files.join(best, "repo", "left").select("repo", "python", "rust", "tests", F.coalesce("candidates", F.lit(0)).alias("candidates"), "top", kind.alias("class"))


#: The rules that a description names, by role.
DEFAULT_RULES = (
    ("entry_point", "keep the public surface stable"), ("hub", "damp changes by stability"), ("directory_container", "follow the children"), ("utility_propagation", "pass changes on"), ("identity", "keep the state"), ("sink", "absorb changes"),
)


def default_rules_table(spark) -> DataFrame:
    return spark.createDataFrame(DEFAULT_RULES, "role string, rule string")


def node_configs(description: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """id, path, kind, stability, rule; overrides (id, rule) win over the role's own name."""
    d = description.select("id", F.coalesce("path", "name").alias("path"), "kind", "stability", "role")
    if overrides is None:
        return d.withColumnRenamed("role", "rule")
    named = overrides.select("id", F.col("rule").alias("own"))
    return d.join(named, "id", "left").select("id", "path", "kind", "stability", F.coalesce("own", "role").alias("rule"))


def structural_features(description: DataFrame) -> DataFrame:
    """What a model sees of a node when it names rules."""
    return description.select("id", "role", "in_degree", "out_degree", F.round("norm_in", 6).alias("norm_in"), S.is_entry_point("name").alias("entry"))


def visible_rows(report: DataFrame, least: float = 0.01, most: int = 20) -> DataFrame:
    return report.where(F.col("activation") >= least).orderBy(F.desc("activation"), "id").limit(most)


def effective(nodes: DataFrame, config: DataFrame, stability: float = DEFAULT_TARGET, rule: str = "identity", inheritance: str = "inherit") -> DataFrame:
    """id, stability, rule and inheritance of each node: those of its configuration (id and these, any null), else the defaults."""
    own = config.select("id", *[F.col(c).alias(f"__{c}") for c in ("stability", "rule", "inheritance")])
    return nodes.select("id").join(own, "id", "left").select("id", F.coalesce("__stability", F.lit(stability)).alias("stability"), F.coalesce("__rule", F.lit(rule)).alias("rule"), F.coalesce("__inheritance", F.lit(inheritance)).alias("inheritance"))


def node_stability(nodes: DataFrame, config: DataFrame) -> DataFrame:
    """id, stability: 0 where the configuration names none."""
    return effective(nodes, config.select("id", "stability", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("inheritance")), 0.0).select("id", "stability")


def recommendation(has_test: Column, cost: Column, dependents: Column) -> Column:
    """What to do with a migration target; the first that holds."""
    return F.when(~has_test, "port tests first").when(cost >= 0.7, "defer").when(dependents > 5, "shadow behind the old interface").otherwise("move as a helper")
