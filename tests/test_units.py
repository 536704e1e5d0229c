import json
import re
import subprocess
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from skein import graph
from skein.functions import code, logs, scalars
from skein.graph import Graph
from skein.operators import automaton as A
from skein.operators import degrees as D
from skein.operators import joins as J
from skein.operators import layout as L
from skein.operators import planning as P
from skein.operators import search as R
from skein.operators import traversal as T
from skein.samplers import Constitution, DegreeSampler, EmbeddingSampler, MetadataSampler, ModelRule, NoOpSampler, Pipeline
from skein.sources import project, render, scan, vcs
from skein.sources.store import Store, read_graph_json, write_graph_json
from skein.streaming import changes


@pytest.fixture(scope="module")
def small(spark):
    nodes = [(0, "src", "Directory", "src"), (1, "lib.rs", "File", "src/lib.rs"), (2, "a_utils.rs", "File", "src/a_utils.rs"), (3, "test_a.rs", "Test", "src/test_a.rs"), (4, "lone.rs", "File", "lone.rs")]
    edges = [(0, 1, "contains", 0), (0, 2, "contains", 1), (0, 3, "contains", 2), (1, 2, "uses", 3), (3, 2, "imports", 4), (2, 2, "uses", 5), (1, 2, "imports", 6), (1, 99, "uses", 7)]
    n = spark.createDataFrame(nodes, "id long, name string, kind string, path string").withColumn("pos", F.col("id"))
    n = n.withColumn("metadata", F.create_map(F.lit("path"), F.col("path")))
    return Graph(n, spark.createDataFrame(edges, "src long, dst long, relationship string, pos long")).clean()


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_graph(small, spark):
    assert small.edges.count() == 7
    assert {(r.id, r.peer): r.relationship for r in small.adjacency().collect()}[2, 1] == "uses"
    assert small.add_edges(spark.createDataFrame([(4, 1, "uses", 9), (4, 4, "uses", 9), (4, 77, "uses", 9)], "src long, dst long, relationship string, pos long")).edges.count() == 8
    more = small.with_metadata(spark.createDataFrame([(1, "true")], "id long, value string"), "has_tests").nodes
    assert [r.metadata for r in more.where("id = 1").collect()] == [{"path": "src/lib.rs", "has_tests": "true"}]
    assert ids(small.where(F.col("kind") == "File").nodes) == [1, 2, 4]


def test_degrees_count_loops_both_ways(small):
    d = {r.id: (r.in_degree, r.out_degree) for r in D.degrees(small).collect()}
    assert d == {0: (0, 3), 1: (1, 2), 2: (5, 1), 3: (1, 1), 4: (0, 0)}
    assert ids(D.orphans(small)) == [4] and ids(D.leaves(small)) == [4] and ids(D.roots(small)) == [0, 4]
    assert ids(D.hubs(small, 1)) == [2]


def test_empty_graph(small):
    g = Graph(small.nodes.limit(0), small.edges.limit(0))
    assert D.degrees(g).count() == 0 and D.normalised(g).count() == 0 and P.describe(g).count() == 0
    assert D.graph_counts(g).first().node_count == 0


def test_selectors_and_search(small):
    assert ids(R.Selector.has_metadata("path").matches(small.nodes)) == [0, 1, 2, 3, 4]
    assert ids(R.Selector.all().matches(small.nodes)) == [0, 1, 2, 3, 4]
    got = R.search_nodes(small.nodes, "SRC", limit=2).collect()
    assert [(r.id, r.total) for r in got] == [(0, 4), (1, 4)]
    assert R.run_search(small.nodes, "s").count() == 0
    assert R.find_by_path(small.nodes, "LIB.rs").first().id == 1 and R.find_by_path(small.nodes, "nothing").count() == 0
    assert R.find_relationship(small, 3, 0).first()[0] == "contains" and R.find_relationship(small, 3, 4).first()[0] == "unknown"


def test_joins(small, spark):
    assert ids(J.neighbors(small, 2), "peer") == [0, 1, 1, 2, 3]
    assert ids(J.tested(small)) == [2]
    assert [r.path for r in J.related_paths(small, 1).collect()] == ["src/a_utils.rs"]
    assert sorted(r.root for r in J.common_prefix(small.nodes.where("id between 1 and 3")).collect()) == ["src"]
    paths = spark.createDataFrame([("a/b/c.rs",), ("a/bc.rs",), ("z",)], "path string")
    assert {r.path: r.root for r in J.longest_prefix(paths, spark.createDataFrame([("a",), ("a/b",)], "root string")).collect()} == {"a/b/c.rs": "a/b", "a/bc.rs": "a", "z": None}
    refs = spark.createDataFrame([(9, "utils.rs", "uses"), (9, "./src/lib.rs", "uses"), (1, "lib.rs", "uses"), (9, "none.rs", "uses")], "source_id long, route string, kind string")
    assert {r.route: (r.target_id, r.strategy) for r in J.resolve_routes(refs, small.nodes).collect()} == {"utils.rs": (2, 1), "./src/lib.rs": (1, 2)}


def test_traversal(small, spark):
    seed = small.nodes.where("id = 2")
    assert [(r.id, r.depth) for r in T.impact(small, seed).collect()] == [(1, 1), (3, 1)]
    assert ids(T.expand(small, seed, 2)) == [0, 1, 2, 3] and ids(T.expand(small, seed, 1, "replace")) == [0, 1, 3]
    assert ids(T.context(small, 1).nodes) == [0, 1, 2]
    rank = {r.id: r["rank"] for r in T.pagerank(small).collect()}
    assert sum(rank.values()) == pytest.approx(1.0) and max(rank, key=rank.get) == 2
    assert T.architect(small, "modular").nodes.count() == 4
    with pytest.raises(ValueError):
        T.architect(small, "none")


def test_rules_and_runs(small):
    state = A.initial_state(small.nodes, F.when(F.col("id") == 2, 1.0).otherwise(0.0), F.col("id") == 2)
    adjacency = small.adjacency()
    one = {r.id: r.activation for r in A.tick(state, adjacency, A.Registry(A.ImportPropagation())).collect()}
    assert one[1] == pytest.approx(0.3 * 0.8 * 0.3) and one[2] == pytest.approx(0.7 + 0.3 * 0.8 * 0.3) and one[4] == 0
    near = {r.id: r.activation for r in A.tick(state.withColumn("activation", F.lit(0.1)), adjacency, A.Registry(A.ChangeProximity())).collect()}
    assert near[2] == pytest.approx(0.6) and near[1] == pytest.approx(0.3) and near[4] == pytest.approx(0.1)
    same = A.apply_rule(state, adjacency, A.Registry(A.NoOp()), "noop")
    assert {r.id: r.activation for r in same.collect()}[2] == 1.0
    with pytest.raises(KeyError):
        A.Registry().get("x")
    both = A.Composite([A.ModuleActivation(), A.ImportPropagation()])
    assert A.tick(state, adjacency, [both, A.Delegate(F.lit(False), A.NoOp())]).count() == 5
    seeds = small.nodes.where("id = 2")
    run = A.change_explorer(small, seeds)
    run.max_ticks = 4
    assert len(run.run().history) == 4 and run.ticks().count() == 4 and run.reset().history == []
    assert A.impact_analyzer(small, seeds).run_until_still(3) in (True, False)
    ticks = [A.Tick(k, 0, 5, 0.5) for k in range(5)]
    assert A.quiet(ticks) and A.converged(ticks) and not A.quiet(ticks[:2]) and not A.converged(ticks[:4])
    assert A.Tick(1, 0, 0, 0.0).rate == 0


def test_blinker_has_period_two(spark):
    g = T.lattice(spark, 8, 8)
    alive = {26, 27, 28}
    run = A.Automaton(g, A.Registry(A.Life()), A.seeded(A.initial_state(g.nodes), F.col("id").isin(*alive), 1.0))
    assert set(ids(A.hot(run.run_ticks(1).state, 0.5))) == {19, 27, 35}
    assert set(ids(A.hot(run.run_ticks(1).state, 0.5))) == alive


def test_plan_goal_errors_and_task(small, spark):
    errors = spark.createDataFrame([("work/src/test_a.rs", "boom", 0)], "file string, message string, pos int")
    items = P.evolution_plan(small, ticks=1, goal="improve lone parts", errors=errors).collect()
    assert [(r.id, r.action) for r in items] == [(3, "fix: boom")]
    again = P.evolution_plan(small, ticks=1, goal="improve test_a parts").collect()
    assert again[0].action == "improve test_a parts (goal-directed)" and items[0].priority == pytest.approx(again[0].priority / 3 * 5)
    frame = P.plan_items(P.structural(small).withColumn("propagated", F.lit(0.0)), J.tested(small))
    task = json.loads(P.next_task(frame, small).first().task)
    assert task["path"] and task["steps"]
    assert P.next_task(frame.limit(0), small).count() == 0
    q = P.quality(frame, 5, errors=1).first()
    assert q.status == "Blocked" and not q.all_passed
    assert P.summary(frame.limit(0), 0).first().health == 1.0
    assert "# Plan" in render.plan_markdown(frame, P.summary(frame, 5)).first().text
    assert "# Quality" in render.quality_markdown(P.quality(frame, 5)).first().text
    assert render.task_markdown(P.next_task(frame, small)).first().text.startswith("# ")
    desc = P.describe(small)
    assert "contracts" in render.contracts_markdown(P.contracts(desc)).first().text
    report = P.impact_report(desc, A.initial_state(small.nodes, 0.8))
    assert "| High |" in render.impact_markdown(report).first().text


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.epoch_to_iso(F.lit(86400)).alias("iso"), scalars.relative_time(F.lit(7200)).alias("ago"), scalars.identifier(F.lit("1a-b")).alias("ident"), scalars.slugify(F.lit("/A b.c/")).alias("slug"), scalars.truncate_label(F.lit("abcdefgh"), 5).alias("cut"),
        scalars.diagnostic_line(F.lit("\n x\ny timed out")).alias("line"), scalars.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("cos"), scalars.extension(F.lit("a/.hidden")).alias("ext"),
    ).first()
    assert tuple(row) == ("1970-01-02T00:00:00Z", "2h ago", "_1a_b", "a_b_c", "ab...", "y timed out", 0.0, "")


def test_excerpt_stops_at_its_bound(spark):
    text = "\n".join(f"use a{k};" for k in range(30)) + "\nlet x = 1;\npub fn f() {}\n/// doc"
    out = spark.createDataFrame([(text, "rust"), (text, "cobol")], "c string, l string").select(code.excerpt(F.col("c"), F.col("l")).alias("e")).collect()
    assert out[0].e.split("\n") == [f"use a{k};" for k in range(15)] + ["pub fn f() {}", "/// doc"] and out[1].e is None


def test_logs_without_rows(spark):
    empty = spark.createDataFrame([], "pos int, name string, exit_code int, stderr string, stdout string")
    assert logs.parse_errors(empty).count() == 0 and logs.feedback(empty, logs.parse_errors(empty)).first().passed == 0


def test_scan_graph_and_store(spark, tmp_path):
    root = tmp_path / "work"
    for name, text in {"src/lib.rs": "mod util;", "src/util.rs": "#[test]", "node_modules/x.js": "x", ".hidden/y.py": "y", "app/main.py": "from src.util import z", "data.bin": "a\x00b"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    files = scan.sync(spark, str(root))
    assert sorted(r.relative_path for r in files.collect()) == ["app/main.py", "data.bin", "src/lib.rs", "src/util.rs"]
    assert scan.scan(spark, str(root), options=scan.ScanOptions(extensions={"rs"}, max_size=8)).count() == 1
    assert scan.scan_store(spark, str(root), "work", options=scan.ScanOptions(extensions={"rs"})).count() == 2
    full = scan.with_content(spark, files)
    assert {r.relative_path: r.content for r in full.collect()}["data.bin"] is None
    g = scan.build_graph(full)
    path = {r.id: r.path for r in g.nodes.collect()}
    assert ("src/lib.rs", "src/util.rs", "uses") in {(path[r.src], path[r.dst], r.relationship) for r in g.edges.collect()}
    assert {r.path for r in g.nodes.where("has_tests").collect()} == {"src/util.rs"}
    store = Store(spark, str(tmp_path / "store"))
    assert store.load_graph() is None and store.load_vectors() is None and store.stats() == {"bytes": 0, "files": 0}
    store.save_graph(g)
    assert store.load_graph().nodes.count() == g.nodes.count()
    store.save_project(full)
    assert "content" not in store.load("project").columns
    for at in (1000, 3000, 2000):
        store.snapshot("state", g.nodes.limit(at // 1000), at)
    assert store.snapshots("state") == [3000, 2000, 1000] and store.load_snapshot("state").count() == 3
    assert store.prune("state", 1) == 2 and store.snapshots("state") == [3000]
    store.save_vectors(spark.createDataFrame([(1, [0.5])], "id long, embedding array<float>"), "m", 1)
    assert store.load_vectors()[1] == {"model": "m", "dim": 1}
    store.append_event("graph_updated", {"n": 1})
    store.append_event("error", {})
    assert [r.type for r in store.events().collect()] == ["graph_updated", "error"]
    assert store.read_through("project", lambda: 1 / 0).count() == 4 and store.stats()["files"] > 3
    write_graph_json(g, str(tmp_path / "graph.json"))
    back = read_graph_json(spark, str(tmp_path / "graph.json"))
    assert back.edges.count() == g.edges.count() and sorted(r.path for r in back.nodes.collect()) == sorted(path.values())
    store.clean()
    assert not store.exists("project")


def test_sync_sources():
    assert scan.sync_source("./x")["type"] == "local" and scan.sync_source("acme") == {"type": "org", "org": "acme"}
    assert scan.sync_source("https://github.com/acme/tool.git") == {"type": "repo", "org": "acme", "repo": "tool"}
    assert scan.remote_info("acme")["is_org"] and not scan.remote_info("git@github.com:acme/tool.git")["is_org"]


def test_read_file_stays_below_its_root(tmp_path):
    (tmp_path / "a.py").write_text("x\ny")
    assert scan.read_file(str(tmp_path), "a.py") == {"path": "a.py", "content": "x\ny", "lines": 2, "language": "python"}
    with pytest.raises(PermissionError):
        scan.read_file(str(tmp_path / "sub"), "../a.py")


def test_version_control(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    run("config", "user.email", "a@b.c")
    run("config", "user.name", "A")
    (tmp_path / "a.txt").write_text("1\n")
    run("add", "a.txt")
    run("commit", "-qm", "first")
    (tmp_path / "a.txt").write_text("2\n")
    (tmp_path / "b.txt").write_text("b")
    assert sorted((r.path, r.kind, r.staged) for r in vcs.changes(spark, str(tmp_path)).collect()) == [("a.txt", "Modified", False), ("b.txt", "Untracked", False)]
    assert tuple(vcs.summary(vcs.changes(spark, str(tmp_path))).first()) == (1, 0, 0, 1)
    assert [r.message for r in vcs.log(spark, str(tmp_path)).collect()] == ["first"] and len(vcs.head(str(tmp_path))) == 8
    assert tuple(vcs.diff(spark, str(tmp_path)).drop("patch").first()) == (1, 1, 1)
    assert vcs.branches(spark, str(tmp_path)).where("is_current").count() == 1
    assert vcs.status_rows("MM a\0R  new\0old\0?? c\0") == [("a", "Modified", True), ("a", "Modified", False), ("new", "RenamedTo", True), ("c", "Untracked", False)]
    assert scan.workspace(str(tmp_path))["kind"] == "single" and scan.workspace(str(tmp_path.parent))["kind"] == "multi"


def test_project_config(tmp_path):
    assert project.detect_type(str(tmp_path)) is None
    (tmp_path / "package.json").write_text('{"scripts": {"test": "x", "odd": "y"}}')
    assert project.infer(str(tmp_path)).scripts == {"test": "npm run test"}
    (tmp_path / "Cargo.toml").write_text("")
    assert project.resolve(str(tmp_path)).watch_scripts() == [("check", "cargo check"), ("test", "cargo test")]
    c = project.ProjectConfig("p", {"b": "x", "a": "y"}, ["a", "zz"], None, {"hub": 0.9})
    (tmp_path / "vg.toml").write_text(project.to_toml(c))
    back = project.resolve(str(tmp_path))
    assert back == c and back.watch_scripts() == [("a", "y")] and back.objective()["hub"] == 0.9 and back.objective()["sink"] == 0.3


def test_samplers(small, spark):
    assert len(NoOpSampler().sample(small)) == 0
    assert json.loads(DegreeSampler().sample(small).get(2)) == {"in": 5, "out": 1, "total": 6}
    assert len(MetadataSampler(["none"]).sample(small)) == 0 and len(list(MetadataSampler().sample(small))) == 5
    notes = {r.id: r.annotations for r in Pipeline(DegreeSampler(), EmbeddingSampler(4, lambda t: [[1.0] * 4 for _ in t])).run(small).collect()}
    assert set(notes[1]) == {"degree", "embedding"} and notes[0] == {}
    rule = ModelRule(lambda prompts: ['```json\n{"activation": 2.0}\n```' if '"n":0' not in p else "?" for p in prompts])
    out = {r.id: (r.activation, r.feedback) for r in rule.tick(small, A.initial_state(small.nodes, 0.5)).collect()}
    assert out[1] == (1.0, None) and out[4] == (0.5, "unreadable answer")
    law = Constitution("c")
    assert small.nodes.where(law.allowed()).count() == 5 and small.nodes.where(law.add_evaluator(F.col("kind") == "File").allowed()).count() == 3


def test_layout(small):
    at = L.start(T.random_graph(small.nodes.sparkSession, 300).nodes)
    near = {r.id: (r.fx, r.fy) for r in L.exact_repulsion(at, at, 1000.0).collect()}
    tree = {r.id: (r.fx, r.fy) for r in L.repulsion(at, L.Config(theta=0.3)).collect()}
    size = sum(abs(v) for f in near.values() for v in f)
    assert sum(abs(a - b) for k in near for a, b in zip(near[k], tree[k])) < 0.1 * size
    own = L.Layout().init(small).start()
    own.step()
    assert own.steps == 1 and own.pause().state == "paused" and own.step().count() == 5 and own.steps == 1
    assert (L.iterations(10), L.iterations(1000), L.iterations(9000)) == (10, 5, 2)


def test_streams(spark, tmp_path):
    schema = "key string, ts timestamp, fingerprint string"
    rows = [("a", "2024-01-01 00:00:01", "x"), ("a", "2024-01-01 00:00:02", "x"), ("a", "2024-01-01 00:00:03", "y"), ("b", "2024-01-01 00:00:01", "x"), ("a", "2024-01-01 00:00:04", "x")]
    frame = spark.createDataFrame(rows, "key string, ts string, fingerprint string").withColumn("ts", F.col("ts").cast("timestamp"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = changes.events_stream(spark, str(tmp_path / "in"), schema)
    q = changes.only_changes(stream).writeStream.format("memory").queryName("changed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, changes.only_changes_batch(frame).collect()))
    assert sorted(map(tuple, spark.table("changed").collect())) == want and len(want) == 4
    t = [0.0]
    p = changes.Poller(lambda: t[0], 0.5, lambda: t[0])
    assert p.poll() == 0.0
    t[0] = 0.4
    assert p.poll() == 0.0 and p.force_poll() == 0.4 and p.cached() == 0.4
    assert changes.playback([1, 2, 3], 4.2, 1.0) == 1 and changes.playback([], 1, 1) == 0


def test_many_edges_are_dealt_over_tasks(spark, small, monkeypatch):
    """By a graph's own estimate, so that what a task sums doesn't grow with it; nothing else changes."""
    monkeypatch.setattr(graph, "PART", 1)
    large = replace(small, about=lambda: 300)
    assert large.parts() == 300 and small.parts() == 0 and replace(small, about=lambda: 1).parts() == 0
    for made in (D.degrees, lambda g: J.adjacency_lists(g.edges, g.parts()), lambda g: T.pagerank(g, rounds=3).select("id", F.round("rank", 9))):
        assert sorted(map(tuple, made(large).collect())) == sorted(map(tuple, made(small).collect()))
    for made in (D.degrees(large), J.adjacency_lists(large.edges, large.parts())):
        assert re.search(r"hashpartitioning\([^)]*, 300\)", made._jdf.queryExecution().executedPlan().toString())
    # By pos first, with ties by id: parallel and opposite edges of one pos too.
    edges = spark.createDataFrame([(1, 3, "uses", 0), (1, 2, "uses", 0), (1, 0, "uses", 1), (2, 1, "uses", 0), (1, 2, "imports", 0)], small.edges.schema)
    assert sorted(map(tuple, J.adjacency_lists(edges).collect())) == [(0, "in", 1, 1), (1, "in", 1, 2), (1, "out", 4, 2), (2, "in", 2, 1), (2, "out", 1, 1), (3, "in", 1, 1)]
