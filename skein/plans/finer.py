"""Operators that the other plans use only inside of others, each with a query of its own."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import api, table_functions
from ..functions import code, logs, scalars as S
from ..operators import automaton as A
from ..operators import joins as J
from ..operators import layout as L
from ..operators import layout3d as L3
from ..operators import planning as P
from ..operators import search as R
from ..operators import selection
from ..operators import traversal as T
from ..operators import vectors as V
from ..operators.tables import cut
from ..operators.text_index import TextIndex
from ..operators.cells import CellSystem
from ..protocols import EmptyScanner, FileMaterializer, FolderRegions, FolderScanner, NoRegions, ScriptRunner
from ..samplers import Constitution, DegreeSampler, EmbeddingSampler, ModelRule, Sampler
from ..sources import project, render, scan, scripts, vcs
from ..sources.store import Store
from ..streaming import changes as C
from .extras import _half_up
from .iterative import ACTION, ITEMS, MIG, OUT, PLACES, RAN, ROLES, SEED, SQL, _places, _seeded, _structural_items, seeded_ids, ticks_sql
from .projections import doc_graph, fk_graph
from .registry import ORACLES, query, r6
from .relational import BOTH, CELLS, DOC, FK, NATION, torus
from .surface import FILES, SEEN, shared, table_sql, values, work_folder
from .textual import SRC_SQL, sources

# Scans, projects, version control


@query("a5_scan_options", table_sql([(".hidden/y.py",), ("src/lib.rs",), ("src/util.rs",)], "relative_path"))
def _(s, d):
    o = scan.ScanOptions(exclude={"app"}, extensions={"rs", "py"}, max_size=50, include_hidden=True)
    return scan.scan(s, work_folder(s), options=o).select("relative_path")


@query("a6_projected_sources", table_sql([(p, os.path.basename(p), len(FILES["repo/" + p])) for p in SEEN], "relative_path, name, size"))
def _(s, d):
    at = work_folder(s)
    rows = scan.scan_store(s, "file://" + at, "repo")
    return rows.select("relative_path", "name", F.col("size").cast("int").alias("size"))


@query("a9_synced", table_sql([(p,) for p in SEEN], "relative_path"))
def _(s, d):
    return scan.sync(s, work_folder(s)).select("relative_path")


@query("a10_synced_once", table_sql([(len(SEEN), len(SEEN), len(SEEN) + 1)], "first, stored, forced"))
def _(s, d):
    """A second sync reads what the first stored, unless forced."""
    at = work_folder(s)
    ops = api.Ops(s, at)
    first = ops.sync().count()
    with open(os.path.join(at, "new.txt"), "w", encoding="utf-8") as f:
        f.write("x")
    return values(s, [(first, ops.sync().count(), ops.sync(force=True).count())], "first int, stored int, forced int")


def _repos(s) -> str:
    """A folder with two repositories and a branch, by the tool itself."""
    at = os.path.dirname(work_folder(s)) + "/many"
    for name in ("one", "two"):
        os.makedirs(f"{at}/{name}")
        vcs._done(f"{at}/{name}", "init", "-q")
        for k, text in enumerate(("first", "second")):
            with open(f"{at}/{name}/a.txt", "w", encoding="utf-8") as f:
                f.write(text * (k + 1))
            vcs.add(f"{at}/{name}", ["a.txt"])
            vcs.commit(f"{at}/{name}", text)
    with open(f"{at}/two/b.txt", "w", encoding="utf-8") as f:
        f.write("new")
    with open(f"{at}/one/a.txt", "w", encoding="utf-8") as f:
        f.write("changed")
    return at


@query("a11_many_repositories", table_sql([("one", "a.txt"), ("two", "a.txt"), ("two", "b.txt")], "repo, relative_path"))
def _(s, d):
    return scan.sync(s, _repos(s)).select("repo", "relative_path")


class _Host(scan.Remote):
    """A code host that lists as many repositories as asked and has one folder."""

    def __init__(self, n: int, folder: str = ""):
        self.n, self.folder, self.pages = n, folder, 0

    def list(self, org, page, per_page):
        self.pages += 1
        return [f"r{k}" for k in range((page - 1) * per_page, min(self.n, page * per_page))]

    def fetch(self, org, repo):
        return self.folder


@query("a12_listed_remotes", table_sql([(0, 0, 1), (99, 98, 1), (100, 99, 2), (250, 249, 3), (1500, 999, 10)], "repositories, listed, pages"))
def _(s, d):
    rows = []
    for n in (0, 99, 100, 250, 1500):
        host = _Host(n)
        rows.append((n, len(scan.list_remote(host, "org", {"r7"})), host.pages))
    return values(s, rows, "repositories int, listed int, pages int")


@query("a13_synced_remote", table_sql([("tool", p) for p in SEEN], "repo, relative_path"))
def _(s, d):
    return scan.sync_remote(s, _Host(1, work_folder(s)), "https://github.com/acme/tool.git").select("repo", "relative_path")


@query("a17_loaded_project", table_sql([(p,) for p in SEEN], "relative_path"))
def _(s, d):
    ops = api.Ops(s, work_folder(s))
    ops.store.save_project(scan.with_content(s, scan.sync(s, ops.folder)))
    return ops.load().select("relative_path")


@query("a19_listed_snapshots", table_sql([(3000, 0), (2000, 1), (1000, 2)], "taken, place"))
def _(s, d):
    st = Store(s, shared(s, "store"))
    for at in (2000, 1000, 3000):
        st.snapshot("state", s.range(1), at)
    return values(s, [(at, k) for k, at in enumerate(st.snapshots("state"))], "taken int, place int")


@query("a20_loaded_artefacts", f"{FK}{ROLES} SELECT id, role, round(stability, 6) AS stability FROM des")
def _(s, d):
    st = Store(s, shared(s, "store"))
    st.save("description", P.describe(fk_graph(s, d)))
    return st.load("description").select("id", "role", r6("stability"))


@query("a21_loaded_snapshot", "SELECT event_id FROM events WHERE event_type = 'click'")
def _(s, d):
    st, e = Store(s, shared(s, "store")), s.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    for at, kind in ((5, "view"), (7, "click"), (9, "purchase")):
        st.snapshot("events", e.where(F.col("event_type") == kind), at)
    return st.load_snapshot("events", 7).select("event_id")


@query("a22_missing_vectors", table_sql([("empty", False), ("no meta", False), ("both", True)], "store, found"))
def _(s, d):
    rows, index = [], s.range(3).select("id", V.zero_embedding(4).alias("embedding"))
    for name in ("empty", "no meta", "both"):
        st = Store(s, shared(s, "store"))
        if name == "no meta":
            st.vectors().replace(index)
        if name == "both":
            st.save_vectors(index, "zero", 4)
        rows.append((name, st.load_vectors() is not None))
    return values(s, rows, "store string, found boolean")


@query("a24_log", table_sql([(0, "second"), (1, "first")], "pos, message"))
def _(s, d):
    return vcs.log(s, _repos(s) + "/one").select("pos", "message")


@query("a26_branches", table_sql([("topic", True, False)], "name, is_current, is_remote"))
def _(s, d):
    at = _repos(s) + "/one"
    vcs.checkout(at, "topic", create=True)
    return vcs.branches(s, at).where("name = 'topic'").select("name", "is_current", "is_remote")


@query("a27_changes_of_all", table_sql([("one/a.txt", "Modified"), ("two/b.txt", "Untracked")], "path, kind"))
def _(s, d):
    at = _repos(s)
    return vcs.project_changes(s, [f"{at}/one", f"{at}/two"]).select(F.regexp_replace("path", ".*/many/", "").alias("path"), "kind")


TOML = '[project]\nname = "own"\n\n[scripts]\ntest = "make t"\nlint = "make l"\n\n[watch]\nrun = ["lint", "none"]\n\n[stability]\nhub = 0.99\n'


def _configured(s) -> str:
    at = work_folder(s)
    with open(os.path.join(at, project.CONFIG_FILE), "w", encoding="utf-8") as f:
        f.write(TOML)
    return at


@query("a28_configuration", table_sql([("own", "lint", "make l"), ("own", "test", "make t")], "project, script, command"))
def _(s, d):
    c = project.load(_configured(s))
    return values(s, [(c.name, *x) for x in c.scripts.items()], "project string, script string, command string")


@query("a29_resolved_configuration", table_sql([("file", "own", "make t"), ("workspace", "app", "make t"), ("inferred", "repo", "npm run test")], "found, name, test"))
def _(s, d):
    plain, at = work_folder(s), _configured(s)
    found = [("file", project.resolve(at)), ("workspace", project.resolve(at + "/app", at)), ("inferred", project.resolve(plain))]
    return values(s, [(k, c.name, c.scripts["test"]) for k, c in found], "found string, name string, test string")


@query("a31_inferred_scripts", table_sql([("Cargo.toml", "rust", "cargo test"), ("go.mod", "go", "go test ./..."), ("pyproject.toml", "python", "pytest")], "marker, type, test"))
def _(s, d):
    rows = []
    for marker in ("Cargo.toml", "go.mod", "pyproject.toml"):
        at = os.path.dirname(work_folder(s)) + "/" + marker.replace(".", "_")
        os.makedirs(at)
        open(os.path.join(at, marker), "w").close()
        rows.append((marker, project.detect_type(at), project.infer(at).scripts["test"]))
    return values(s, rows, "marker string, type string, test string")


@query("p30_inferred_configuration", table_sql([("repo", "test", 1)], "name, watched, scripts"))
def _(s, d):
    c = project.infer(work_folder(s))
    return values(s, [(c.name, c.watch[0], len(c.scripts))], "name string, watched string, scripts int")


@query("p34_workspace_defaults", table_sql([("app", "make l")], "name, command"))
def _(s, d):
    at = _configured(s)
    c = project.resolve(at + "/app", at)
    return values(s, [(c.name, c.watch_scripts()[0][1])], "name string, command string")


@query("p35_has_watch_scripts", table_sql([("both", True), ("no script", False), ("none", False)], "name, has"))
def _(s, d):
    made = {"both": (["a"], {"a": "x"}), "no script": (["a"], {"b": "x"}), "none": ([], {"a": "x"})}
    return values(s, [(k, project.ProjectConfig(k, c, w).has_watch_scripts()) for k, (w, c) in made.items()], "name string, has boolean")


@query("p49_file_paths", table_sql([("there", "abs"), ("gone", "rel"), ("none", "rel")], "name, found"))
def _(s, d):
    at = work_folder(s)
    by = lambda a: "abs" if scan.resolve_file_path(a, "/w", "src/lib.rs") == a else "rel"
    return values(s, [("there", by(at + "/src/lib.rs")), ("gone", by(at + "/src/gone.rs")), ("none", by(None))], "name string, found string")


@query("b17_mutations", table_sql([("staged", True), ("unstaged", False), ("committed", True), ("nothing to commit", False), ("no such branch", False)], "step, holds"))
def _(s, d):
    at = _repos(s) + "/one"
    staged = lambda: vcs.changes(s, at).where("staged").count() > 0
    vcs.add(at, ["a.txt"])
    rows = [("staged", staged())]
    vcs.reset(at)
    rows.append(("unstaged", staged()))
    vcs.add(at, ["a.txt"])
    rows += [("committed", vcs.commit(at, "third") is not None), ("nothing to commit", vcs.commit(at, "fourth") is not None), ("no such branch", vcs.checkout(at, "none"))]
    return values(s, rows, "step string, holds boolean")


@query("p73_absolute_changes", table_sql([("a.txt", True)], "name, absolute"))
def _(s, d):
    rows = vcs.changes(s, _repos(s) + "/one", absolute=True)
    return rows.select(S.file_name("path").alias("name"), F.startswith("path", F.lit("/")).alias("absolute"))


@query("p79_head", table_sql([(8, True)], "length, same"))
def _(s, d):
    at = _repos(s) + "/one"
    return values(s, [(len(vcs.head(at)), vcs.log(s, at).first()["id"].startswith(vcs.head(at)))], "length int, same boolean")


# Stores


@query("b1_saved_project", table_sql([("name,path,relative_path,repo,size", len(SEEN))], "columns, n"))
def _(s, d):
    st = Store(s, shared(s, "store"))
    st.save_project(scan.with_content(s, scan.scan(s, work_folder(s))))
    have = st.load("project")
    return values(s, [(",".join(sorted(have.columns)), have.count())], "columns string, n int")


@query("b6_saved_history", f"{SQL}{ticks_sql(SEED, ['import'], 2)} SELECT 1 AS tick, count(*) FILTER (moved) AS transitions FROM s1 UNION ALL SELECT 2, count(*) FILTER (moved) FROM s2")
def _(s, d):
    st = Store(s, shared(s, "store"))
    st.save("ticks", _seeded(s, d, A.Registry(A.ImportPropagation())).run_ticks(2).ticks())
    return st.load("ticks").select("tick", "transitions")


@query("b7_pruned", table_sql([(7,), (9,)], "taken"))
def _(s, d):
    st = Store(s, shared(s, "store"))
    for at in (5, 7, 3, 9):
        st.snapshot("x", s.range(1), at)
    st.prune("x", 2)
    return values(s, [(at,) for at in st.snapshots("x")], "taken int")


@query("b8_cleaned", table_sql([("goal", False), ("graph", True)], "name, there"))
def _(s, d):
    st = Store(s, shared(s, "store"))
    for name in ("goal", "graph"):
        st.save(name, s.range(1))
    st.clean("goal")
    return values(s, [(n, st.exists(n)) for n in ("goal", "graph")], "name string, there boolean")


@query("b10_store_stats", table_sql([(True, 2, 0)], "has_bytes, snapshots, after_clean"))
def _(s, d):
    st = Store(s, shared(s, "store"))
    for at in (1, 2):
        st.snapshot("x", s.range(10), at)
    row = [st.stats()["bytes"] > 0, len(st.snapshots("x"))]
    st.clean()
    return values(s, [(*row, st.stats()["files"])], "has_bytes boolean, snapshots int, after_clean int")


@query("b15_latest_commit", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def _(s, d):
    st, o = Store(s, shared(s, "store")), s.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    st.snapshot("commits", o, 1)
    st.snapshot("commits", o.where("o_orderkey % 2 = 1"), 2)
    return st.load_snapshot("commits").select("o_orderkey")


@query("p33_restored_run", f"{SQL}{ticks_sql(SEED, ['proximity', 'import', 'module'], 2)} SELECT id, round(a, 6) AS activation FROM s2")
def _(s, d):
    """A tick, stored; another on what is loaded, its counter anew."""
    st, first = Store(s, shared(s, "store")), _seeded(s, d, A.default_rules()).run_ticks(1)
    st.snapshot("state", first.state)
    again = A.Automaton(first.graph, A.default_rules(), st.load_snapshot("state"))
    again.adjacency = first.adjacency
    return again.run_ticks(1).state.select("id", r6("activation"))


@query("p46_cached_poll", table_sql([(1, 1)], "polled, cached"))
def _(s, d):
    p = C.Poller(lambda: 1, 100.0, lambda: 0.0)
    return values(s, [(p.poll(), p.cached())], "polled int, cached int")


@query("p47_bootstrapped_index", f"{FK} SELECT count(*) AS n, 'feature-hash' AS model, 'fast' AS depth, 64 AS dim FROM nodes WHERE kind IN ('File', 'Module')")
def _(s, d):
    st = Store(s, shared(s, "store"))
    V.bootstrap(st, fk_graph(s, d).nodes)
    index, meta = V.bootstrap(st, fk_graph(s, d).nodes.limit(0))  # stored already: nothing is made
    return index.agg(F.count(F.lit(1)).alias("n"), F.lit(meta["model"]).alias("model"), F.lit(meta["depth"]).alias("depth"), F.lit(meta["dim"]).alias("dim"))


@query("p48_searched_store", "WITH s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 2)) AS score FROM embeddings) SELECT id, round(score, 6) AS score, 'the index is of own, the query of other' AS warning FROM s ORDER BY s.score DESC, id LIMIT 10")
def _(s, d):
    st, index = Store(s, shared(s, "store")), s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    st.save_vectors(index, "own", 64)
    hits, warning = V.search_stored(st, [float(x) for x in V.get(index, 2).first()["embedding"]], "other")
    return hits.select("id", r6("score"), F.lit(warning).alias("warning"))


@query("p50_models", table_sql([("feature-hash", 64), ("zero", 64)], "code, dim"))
def _(s, d):
    return V.available_models(s).select("code", "dim")


@query("p77_semantic_enabled", table_sql([("index and model", True), ("zero model", False), ("no model", False), ("no index", False), ("empty index", False)], "have, enabled"))
def _(s, d):
    index = s.range(2).select("id", V.zero_embedding(4).alias("embedding"))
    rows = [("index and model", index, "own"), ("zero model", index, "zero"), ("no model", index, None), ("no index", None, "own"), ("empty index", index.limit(0), "own")]
    return values(s, [(n, V.semantic_enabled(i, m)) for n, i, m in rows], "have string, enabled boolean")


@query("p78_appended_reports", f"{FK}{ROLES} SELECT 2 AS snapshots, count(*) AS n FROM des")
def _(s, d):
    st, g = Store(s, shared(s, "store")), fk_graph(s, d).cut()
    report = P.impact_report(P.describe(g), A.initial_state(g.nodes))
    for at in (1, 2):
        st.snapshot("impact", report, at)
    return st.load_snapshot("impact").agg(F.lit(len(st.snapshots("impact"))).alias("snapshots"), F.count(F.lit(1)).alias("n"))


# Joins and looks


@query("e12_refreshed", f"{FK}, c AS (SELECT path AS c FROM nodes WHERE kind = 'Test'), hit AS (SELECT id, path FROM nodes WHERE path IN (SELECT c FROM c)) SELECT id FROM hit")
def _(s, d):
    n = fk_graph(s, d).nodes
    return J.match_changed(n, n.where("kind = 'Test'").select(F.concat(F.lit("/work/"), "path").alias("changed")))


@query("e22_errors_in_plan", f"{FK}{ITEMS} SELECT id, round(0.6 * structural * CASE WHEN path = 'parts/part_7.rs' THEN 5 ELSE 1 END, 6) AS priority, CASE WHEN path = 'parts/part_7.rs' THEN 'fix: broken' ELSE {ACTION} END AS action FROM items")
def _(s, d):
    g = fk_graph(s, d).cut()
    errors = values(s, [("PARTS/part_7.rs", "broken", 0), ("parts/part_7.rs", "later", 1)], "file string, message string, pos int")
    items = P.plan_items(P.structural(g).withColumn("propagated", F.lit(0.0)), J.tested(g), errors=errors)
    return items.select("id", r6("priority"), "action")


@query("p27_node_config", f"{FK}{ROLES} SELECT id, path, role AS rule FROM des WHERE id = {NATION + 2}")
def _(s, d):
    return R.get_node(P.node_configs(P.describe(fk_graph(s, d))).withColumn("pos", F.col("id")), NATION + 2).select("id", "path", "rule")


@query("p28_config_by_path", f"{FK}{ROLES} SELECT id, role AS rule FROM des WHERE path = 'parts/part_3.rs'")
def _(s, d):
    config = P.node_configs(P.describe(fk_graph(s, d))).withColumn("pos", F.col("id"))
    return config.join(R.node_id(config, "parts/part_3.rs"), "id").select("id", "rule")


@query("p52_nodes", f"{FK} SELECT id, name, kind FROM nodes")
def _(s, d):
    return _ops_tools(s, d).resource("graph/nodes").select("id", "name", "kind")


@query("p54_metadata", f"{FK} SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def _(s, d):
    return _ops_tools(s, d).resource("graph/metadata").select("kind", "n")


@query("p70_resources", f"{FK} SELECT 'graph' AS uri, (SELECT count(*) FROM nodes) AS n UNION ALL SELECT 'graph/edges', (SELECT count(*) FROM edges)")
def _(s, d):
    t = _ops_tools(s, d)
    counts = t.resource("graph").select(F.lit("graph").alias("uri"), F.col("node_count").alias("n"))
    return counts.unionByName(t.resource("graph/edges").agg(F.lit("graph/edges").alias("uri"), F.count(F.lit(1)).alias("n")))


def _ops_tools(s, d) -> api.Tools:
    p = api.Projects()
    p.register(api.Project("fk", fk_graph(s, d)))
    return api.Tools(s, p)


def _projects(s, *names) -> api.Projects:
    p = api.Projects()
    for n in names:
        p.register(api.Project(n, T.sample_graph(s)))
    return p


@query("p62_resolved_projects", table_sql([("named", "b"), ("only", "a"), ("unnamed", "error"), ("unknown", "error")], "case_, name"))
def _(s, d):
    def named(p, name=None):
        try:
            return p.resolve(name).name
        except KeyError:
            return "error"

    two = _projects(s, "a", "b")
    return values(s, [("named", named(two, "b")), ("only", named(_projects(s, "a"))), ("unnamed", named(two)), ("unknown", named(two, "c"))], "case_ string, name string")


@query("p63_listed_projects", table_sql([("a",), ("b",)], "name"))
def _(s, d):
    return api.Tools(s, _projects(s, "b", "a")).list_projects()


@query("p66_registered_twice", table_sql([(1, 5)], "projects, edges"))
def _(s, d):
    p = _projects(s, "a", "a")
    return values(s, [(len(p.names()), p.resolve("a").graph.edges.count())], "projects int, edges int")


@query("p67_unregistered", table_sql([(True, False, 0)], "first, again, left_"))
def _(s, d):
    p = _projects(s, "a")
    return values(s, [(p.unregister("a"), p.unregister("a"), len(p.names()))], "first boolean, again boolean, left_ int")


@query("p71_single_project", table_sql([(0, False), (1, True), (2, False)], "projects, single"))
def _(s, d):
    return values(s, [(n, _projects(s, *"ab"[:n]).single() is not None) for n in range(3)], "projects int, single boolean")


@query("p72_since_sync", table_sql([(True,)], "recent"))
def _(s, d):
    return values(s, [(0 <= _projects(s, "a").resolve().since_sync() < 60,)], "recent boolean")


def _ops(s) -> api.Ops:
    return api.Ops(s, work_folder(s))


@query("p56_sync", table_sql([(p,) for p in SEEN], "relative_path"))
def _(s, d):
    return _ops(s).sync().select("relative_path")


@query("p57_graph", table_sql([("src", "src/lib.rs", "contains"), ("src", "src/util.rs", "contains"), ("app", "app/main.py", "contains"), ("src/lib.rs", "src/util.rs", "uses")], "from_path, to_path, relationship"))
def _(s, d):
    g = _ops(s).graph()
    at = lambda c, n: g.nodes.select(F.col("id").alias(c), F.col("path").alias(n))
    return g.edges.join(at("src", "from_path"), "src").join(at("dst", "to_path"), "dst").select("from_path", "to_path", "relationship")


@query("p58_status", table_sql([("plain", True)], "kind, stored"))
def _(s, d):
    ops = _ops(s)
    ops.sync()
    st = ops.status()
    return values(s, [(st["workspace"]["kind"], st["files"] > 0)], "kind string, stored boolean")


@query("p59_load", table_sql([(False, len(SEEN))], "before, after"))
def _(s, d):
    ops = _ops(s)
    before = ops.load() is not None
    ops.sync()
    return values(s, [(before, ops.load().count())], "before boolean, after int")


@query("p60_clean", table_sql([(True, False)], "before, after"))
def _(s, d):
    ops = _ops(s)
    ops.sync()
    before = ops.load() is not None
    ops.clean()
    return values(s, [(before, ops.load() is not None)], "before boolean, after boolean")


@query("p61_git_changes", table_sql([("Modified", 1), ("Untracked", 1)], "kind, n"))
def _(s, d):
    return api.Ops(s, _repos(s)).git_changes().groupBy("kind").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("p64_changes", table_sql([(1, 0)], "modified, added"))
def _(s, d):
    p = api.Projects()
    p.register(api.Project("one", T.sample_graph(s), _repos(s) + "/one"))
    return api.Tools(s, p).call("get_git_changes").select(F.col("modified").cast("int").alias("modified"), F.col("added").cast("int").alias("added"))


@query("p74_status_of_many", table_sql([("multi", "one,two")], "kind, repos"))
def _(s, d):
    w = api.Ops(s, _repos(s)).status()["workspace"]
    return values(s, [(w["kind"], ",".join(w["repos"]))], "kind string, repos string")


@query("p75_git_changes_of_one", table_sql([(1,)], "n"))
def _(s, d):
    return api.Ops(s, _repos(s) + "/one").git_changes().agg(F.count(F.lit(1)).cast("int").alias("n"))


# Automaton


def _fired_sql(rules: list[str], ids: dict[str, str]) -> str:
    arms = []
    for r in rules:
        guard, new, moves = (x.replace("{f}", "0.3").replace("{t}", "0.1").replace("{d}", "0.8") for x in OUT[r])
        arms.append(f"WHEN ({guard}) AND ({moves.replace('{n}', f'({new})')}) THEN '{ids[r]}'")
    return "CASE " + " ".join(arms) + " END"


DEFAULT_IDS = {"proximity": "change_proximity", "import": "import_propagation", "module": "module_activation"}


@query("j4_first_outcomes", f"{SQL}{ticks_sql(SEED, list(DEFAULT_IDS), 1)} SELECT id, {_fired_sql(list(DEFAULT_IDS), DEFAULT_IDS)} AS fired FROM j0")
def _(s, d):
    run = _seeded(s, d, A.default_rules())
    return A.evaluate(run.state, run.adjacency, run.rules.by_priority()).select("id", "fired")


@query("j3_run_ticks", f"{SQL}{ticks_sql(SEED, ['import', 'module'], 4)} SELECT id, round(a, 6) AS activation FROM s4")
def _(s, d):
    return _seeded(s, d, A.Registry(A.ImportPropagation(), A.ModuleActivation())).run_ticks(4).state.select("id", r6("activation"))


@query("j23_default_rules", table_sql([(0, "change_proximity", 15), (1, "import_propagation", 10), (2, "module_activation", 5)], "place, rule, priority"))
def _(s, d):
    return values(s, [(k, r.id, r.priority) for k, r in enumerate(A.default_rules().by_priority())], "place int, rule string, priority int")


@query("g7_rules_by_priority", table_sql([(0, "change_proximity"), (1, "damped_propagation"), (2, "import_propagation"), (3, "module_activation"), (4, "complexity")], "place, rule"))
def _(s, d):
    return values(s, [(k, r.id) for k, r in enumerate(A.description_rules().by_priority())], "place int, rule string")


@query("g2_impact_ranking", f"{RAN} SELECT id, row_number() OVER (ORDER BY round(a, 6) DESC, id) AS rank FROM s30 QUALIFY rank <= 25")
def _(s, d):
    g = fk_graph(s, d).cut()
    desc = cut(P.describe(g))
    run = A.with_description(g, desc, g.nodes.where(seeded_ids())).run()
    report = P.impact_report(desc, run.state.withColumn("activation", F.round("activation", 6))).limit(25)
    return J.ranked(report, F.desc("activation"), F.asc("id")).select("id", F.col("rank").cast("long").alias("rank"))


@query("j25_cell_history", table_sql([(5, 2)], "ticks, kept"))
def _(s, d):
    g = T.lattice(s, 6, 6)
    cells = CellSystem(g, A.initial_state(g.nodes, F.when(F.col("id") < 6, 1.0).otherwise(0.0)), _half_up, window=2)
    cells.run(5)
    return values(s, [(5, len(cells.history))], "ticks int, kept int")


def _mean(prompts):
    """The neighbours' mean in whole 64ths, which no engine's sums can tell apart."""
    return [json.dumps({"activation": math.floor(json.loads(p)["neighbors"]["mean"] * 64) / 64}) for p in prompts]


def _quarter(prompts):
    return ['{"activation": 0.25}' for _ in prompts]


def _in_turn_sql() -> str:
    """Ids rise by kind of table, and no edge joins two of a kind: so asking in turn is a step for each kind."""
    out = f"{SQL}, a0 AS (SELECT id, CASE WHEN id % 37 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS a FROM nodes)"
    for k in range(1, 7):
        out += f", a{k} AS MATERIALIZED (SELECT a{k - 1}.id, CASE WHEN a{k - 1}.id // 1000000000 = {k} THEN coalesce(m, 0) ELSE a END AS a FROM a{k - 1} LEFT JOIN (SELECT adj.id, floor(round(avg(a), 6) * 64) / 64 AS m FROM adj JOIN a{k - 1} p ON p.id = peer GROUP BY adj.id) q ON q.id = a{k - 1}.id)"
    return out + " SELECT id, round(a, 6) AS activation FROM a6"


@query("j26_in_turn", _in_turn_sql())
def _(s, d):
    """Each node asked after its neighbours of a lower id."""
    run = _seeded(s, d, A.Registry())
    return ModelRule(_mean).tick_in_turn(run.graph, run.state).select("id", r6("activation"))


@query("j28_run_until_settled", f"{FK} SELECT * FROM (SELECT 1 AS tick, count(*) AS transitions, 0 AS errors FROM nodes UNION ALL SELECT 2, 0, 0)")
def _(s, d):
    g = fk_graph(s, d).cut()
    _, history = ModelRule(_quarter).run(g, A.initial_state(g.nodes))
    return values(s, [(k + 1, *h) for k, h in enumerate(history)], "tick int, transitions long, errors int")


@query("m16_model_rule", f"{SQL} SELECT nodes.id, floor(round(coalesce(avg(CASE WHEN peer % 37 = 0 THEN 1.0 ELSE 0.0 END), 0), 6) * 64) / 64 AS activation FROM nodes LEFT JOIN adj ON adj.id = nodes.id GROUP BY nodes.id")
def _(s, d):
    run = _seeded(s, d, A.Registry())
    return ModelRule(_mean).tick(run.graph, run.state).select("id", r6("activation"))


@query("p31_inferred_rules", f"{FK}{ROLES} SELECT id, CASE WHEN role = 'hub' THEN 'damp' ELSE 'keep' END AS rule FROM des WHERE in_degree > 0")
def _(s, d):
    """A client names a rule for each selected node, from its features."""
    from ..session import ship

    ship(s)
    f = P.structural_features(P.describe(fk_graph(s, d))).where("in_degree > 0")

    def run(batches):
        for b in batches:
            yield b[["id"]].assign(rule=["damp" if r == "hub" else "keep" for r in b["role"]])

    return f.mapInPandas(run, "id long, rule string")


@query("p37_merged_answers", f"{FK} SELECT id, 0.25::DOUBLE AS activation, 'seen' AS feedback FROM nodes")
def _(s, d):
    g = fk_graph(s, d).cut()
    return ModelRule(lambda prompts: ['{"activation": 0.25, "feedback": "seen"}' for _ in prompts]).tick(g, A.initial_state(g.nodes))


@query("p38_payloads", f"{SQL} SELECT nodes.id, 'go' AS instruction, count(peer) AS n FROM nodes LEFT JOIN adj ON adj.id = nodes.id GROUP BY nodes.id")
def _(s, d):
    run = _seeded(s, d, A.Registry())
    p = ModelRule(_mean, "go").prompts(run.graph, run.state)
    return p.select("id", F.get_json_object("prompt", "$.instruction").alias("instruction"), F.get_json_object("prompt", "$.neighbors.n").cast("long").alias("n"))


@query("p39_scrubbed", "SELECT doc_id, '{\"n\": ' || doc_id || '}' AS answer FROM documents")
def _(s, d):
    raw = F.concat(F.lit("```json\n{\"n\": "), "doc_id", F.lit("}\n```"))
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", S.scrub_response(raw).alias("answer"))


@query("p41_cell_states", f"{FK} SELECT id, CASE WHEN id % 37 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS activation FROM nodes")
def _(s, d):
    g = fk_graph(s, d)
    return CellSystem(g, A.initial_state(g.nodes, F.when(seeded_ids(), 1.0).otherwise(0.0)), _half_up).state


@query("m10_cell_updates", f"{FK}{BOTH}, s AS (SELECT id, CASE WHEN id % 37 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS a FROM nodes), m AS (SELECT b.id, max(a) AS top FROM both_ways b JOIN s ON s.id = peer GROUP BY b.id) SELECT s.id, coalesce(top, 0.0) AS activation FROM s LEFT JOIN m ON m.id = s.id")
def _(s, d):
    g = fk_graph(s, d).cut()
    return CellSystem(g, A.initial_state(g.nodes, F.when(seeded_ids(), 1.0).otherwise(0.0)), _top).tick().select("id", "activation")


def _top(cells):
    return cells["top"]


class _Halve(A.Rule):
    id, priority = "halve", 3

    def guard(self) -> Column:
        return F.col("activation") > 0

    def apply(self) -> Column:
        return A.outcome(F.col("activation") / 2)


@query("m7_own_rule", f"{FK} SELECT id, CASE WHEN id % 37 = 0 THEN 0.25 ELSE 0.0 END::DOUBLE AS activation FROM nodes")
def _(s, d):
    return _seeded(s, d, A.Registry(_Halve())).run_ticks(2).state.select("id", "activation")


@query("m8_replaced_rule", f"{SQL}{ticks_sql(SEED, ['import'], 1, 0.5)} SELECT id, round(a, 6) AS activation FROM s1")
def _(s, d):
    """A rule registered again replaces the old one: its factor holds."""
    r = A.Registry(A.ImportPropagation(0.3)).register(A.ImportPropagation(0.5))
    return _seeded(s, d, r).run_ticks(1).state.select("id", r6("activation"))


@query("m9_own_heuristic", f"{FK} SELECT 4 AS ticks, count(*) AS transitions FROM nodes")
def _(s, d):
    """A rule that moves every node each tick, until a heuristic of one's own says stop."""
    run = _seeded(s, d, A.Registry(A.NoOp()), stable=lambda history: len(history) == 4, min_ticks=1).run()
    return values(s, [(len(run.history), run.history[-1].transitions)], "ticks int, transitions long")


@query("g14_converged", "WITH t AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) + 1 AS tick, round(avg(value) / 100, 6) AS a FROM events GROUP BY ALL) SELECT tick, count(*) OVER w = 5 AND var_pop(a) OVER w < 0.001 AS converged FROM t WINDOW w AS (ORDER BY tick ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(s, d):
    """Days of events as ticks, their mean value as mean activation."""
    e = s.read.parquet(f"{d}/events.parquet")
    day = (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("long").alias("tick")
    ticks = e.groupBy(day).agg(F.round(F.avg("value") / 100, 6).alias("avg_activation")).withColumns({"transitions": F.lit(1), "skipped": F.lit(1)})
    return A.stability_marks(ticks).select("tick", "converged")


@query("p12_node_stability", f"{FK}{ROLES} SELECT id, CASE WHEN kind = 'Directory' THEN round(stability, 6) ELSE 0.0 END AS stability FROM des")
def _(s, d):
    g = fk_graph(s, d).cut()
    return P.node_stability(g.nodes, P.describe(g).where("kind = 'Directory'")).select("id", r6("stability"))


@query("p16_seeded", f"{FK} SELECT id, CASE WHEN kind = 'Test' THEN 0.9 WHEN id % 2 = 0 THEN 0.4 ELSE 0.0 END::DOUBLE AS activation FROM nodes")
def _(s, d):
    """Seeds in turn: of those that meet, the last wins."""
    n = fk_graph(s, d).nodes
    st = A.seeded(A.initial_state(n).join(n.select("id", "kind"), "id"), F.col("id") % 2 == 0, 0.4)
    return A.seeded(st, F.col("kind") == "Test", 0.9).select("id", "activation")


@query("p17_fast", f"{FK} SELECT 10 AS ticks, 10 * count(*) AS transitions FROM nodes")
def _(s, d):
    """The most ticks of this preset, with a rule that never rests; where no state changes a tick costs nothing."""
    g = fk_graph(s, d).cut()
    run = A.Automaton.fast(g, A.Registry(A.NoOp()), A.initial_state(g.nodes)).run()
    return values(s, [(len(run.history), sum(t.transitions for t in run.history))], "ticks int, transitions long")


@query("p18_thorough", f"{FK} SELECT 500 AS ticks, 500 * count(*) AS transitions FROM nodes")
def _(s, d):
    """The most ticks of this preset, with a rule that never rests; where no state changes a tick costs nothing."""
    g = fk_graph(s, d).cut()
    run = A.Automaton.thorough(g, A.Registry(A.NoOp()), A.initial_state(g.nodes)).run()
    return values(s, [(len(run.history), sum(t.transitions for t in run.history))], "ticks int, transitions long")


@query("p19_had_transitions", f"{SQL}{ticks_sql(SEED, ['import'], 1)} SELECT count(*) FILTER (moved) > 0 AS had FROM s1")
def _(s, d):
    return values(s, [(_seeded(s, d, A.Registry(A.ImportPropagation())).step().had_transitions,)], "had boolean")


@query("p20_reset", f"{SQL}{ticks_sql(SEED, ['import'], 1)} SELECT 0 AS ticks, round(sum(a), 4) AS total FROM s1")
def _(s, d):
    run = _seeded(s, d, A.Registry(A.ImportPropagation())).run_ticks(1).reset()
    return run.state.agg(F.lit(len(run.history)).alias("ticks"), F.round(F.sum("activation"), 4).alias("total"))


@query("p23_avg_activation", f"{SQL} SELECT nodes.id, round(coalesce(avg(CASE WHEN peer % 37 = 0 THEN 1.0 ELSE 0.0 END), 0), 6) AS avg_activation FROM nodes LEFT JOIN adj ON adj.id = nodes.id WHERE kind = 'Directory' GROUP BY nodes.id")
def _(s, d):
    run = _seeded(s, d, A.Registry())
    mine = run.graph.nodes.where("kind = 'Directory'").select("id")
    return A.neighbor_means(run.adjacency, run.state).join(mine, "id", "left_semi").select("id", r6("avg_activation"))


EVENTS = "WITH h AS (SELECT user_id AS id, event_id AS seq, value AS activation, event_type AS rule, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)"


def _transitions(s, d):
    return s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("value").alias("activation"), F.col("event_type").alias("rule"))


@query("g11_recent_by_rule", f"{EVENTS} SELECT id, seq FROM h WHERE n <= 10 AND rule = 'click'")
def _(s, d):
    return A.last_transitions(_transitions(s, d), 10).where("rule = 'click'").select("id", "seq")


@query("p24_history_window", f"{EVENTS} SELECT id, count(*) AS n FROM h WHERE n <= 3 GROUP BY id")
def _(s, d):
    return A.last_transitions(_transitions(s, d), 3).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("p26_trend", f"{EVENTS} SELECT id, round(max(activation) - min(activation), 6) AS spread FROM h WHERE n <= 6 GROUP BY id")
def _(s, d):
    t = A.activation_trend(_transitions(s, d), 5)
    return t.select("id", r6(F.col("max") - F.col("min"), "spread"))


@query("p105_initial_cells", f"WITH {CELLS} SELECT id, 0.0::DOUBLE AS activation, false AS changed FROM cells")
def _(s, d):
    return A.initial_state(torus(s, d).nodes).select("id", "activation", "changed")


# Planning


@query("k11_suggested_actions", f"{FK}{ITEMS} SELECT id, {ACTION} AS action FROM items WHERE kind = 'File'")
def _(s, d):
    items, _ = _structural_items(s, d)
    return items.where("kind = 'File'").select("id", S.suggest_action(F.col("role"), F.col("gap"), F.col("in_degree"), F.col("has_test")).alias("action"))


KPIS = f"{ITEMS}, t AS (SELECT count(*) AS total FROM nodes), q AS (SELECT total, count(items.id) AS below, coalesce(avg(gap), 0) AS ag, coalesce(max(gap), 0) AS mg, count(*) FILTER (role IN ('entry_point', 'hub') AND NOT has_test) AS un FROM t LEFT JOIN items ON true GROUP BY total)"


@query("k15_gates", f"{FK}{KPIS} SELECT false AS gate_errors, 1 - ag * below / total >= 0.85 AS gate_health, (total - below) / total::DOUBLE >= 0.85 AS gate_coverage, ag * below / total <= 0.05 AS gate_avg, mg <= 0.15 AS gate_max, un = 0 AS gate_tests, false AS all_passed FROM q")
def _(s, d):
    items, g = _structural_items(s, d)
    return P.quality(items, g.nodes.count(), 2).select("gate_errors", "gate_health", "gate_coverage", "gate_avg", "gate_max", "gate_tests", "all_passed")


@query("k16_blocked", f"{FK}{KPIS} SELECT 'Blocked' AS status, round((total - below) / total::DOUBLE, 6) AS coverage FROM q")
def _(s, d):
    items, g = _structural_items(s, d)
    return P.quality(items, g.nodes.count(), 1).select("status", r6("coverage"))


PARTS = "SELECT p_partkey, concat(CASE p_partkey % 3 WHEN 0 THEN 'src/parser_' WHEN 1 THEN 'src/api_' ELSE 'src/other_' END, p_partkey, '.py') AS path, p_partkey % 4 > 0 AS has_test, (p_partkey % 11) / 10.0::DOUBLE AS cost, p_size AS n FROM part"


def _parts(s, d):
    p = F.when(F.col("p_partkey") % 3 == 0, "src/parser_").when(F.col("p_partkey") % 3 == 1, "src/api_").otherwise("src/other_")
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(p, "p_partkey", F.lit(".py")).alias("path"), (F.col("p_partkey") % 4 > 0).alias("has_test"), (F.col("p_partkey") % 11 / 10.0).alias("cost"), F.col("p_size").alias("n"))


STRATEGY = "CASE WHEN NOT has_test THEN 'TranspileTestsFirst' WHEN cost >= 0.7 THEN 'Defer' WHEN contains(path, 'parse') THEN 'Pyo3ShadowModule' ELSE 'RustHelperModule' END"


@query("k19_strategies", f"SELECT p_partkey, {STRATEGY} AS strategy FROM ({PARTS})")
def _(s, d):
    return _parts(s, d).select("p_partkey", P.migration_strategy(F.col("path"), F.col("has_test"), F.col("cost")).alias("strategy"))


@query("k20_reasons", f"SELECT p_partkey, concat_ws(', ', CASE WHEN contains(path, 'parse') THEN 'CPU-like name/path' END, CASE WHEN n > 25 THEN 'has dependents' END, CASE WHEN has_test THEN 'test signal present' ELSE 'tests should be ported first' END, CASE WHEN has_test AND cost >= 0.7 THEN 'high migration cost' END) AS reason FROM ({PARTS})")
def _(s, d):
    p, t = F.col("path"), F.col("has_test")
    return _parts(s, d).select("p_partkey", P.migration_reason(p, F.greatest(F.col("n") - 25, F.lit(0)), t, P.migration_strategy(p, t, F.col("cost"))).alias("reason"))


@query("k21_migration_plan", f"{MIG} SELECT row_number() OVER (ORDER BY round(roi, 9) DESC, round(impact, 9) DESC, round(cost, 9), path) AS rank, path, strategy, round(roi, 6) AS roi FROM fin QUALIFY rank <= 10")
def _(s, d):
    c = P.migration_candidates(doc_graph(s, d)).withColumns({k: F.round(k, 9) for k in ("roi", "impact", "cost")})
    return P.ranked_candidates(c, 10).select(F.col("rank").cast("long").alias("rank"), "path", "strategy", r6("roi"))


@query("k23_recommendations", f"SELECT p_partkey, CASE WHEN NOT has_test THEN 'port tests first' WHEN cost >= 0.7 THEN 'defer' WHEN n > 5 THEN 'shadow behind the old interface' ELSE 'move as a helper' END AS advice FROM ({PARTS})")
def _(s, d):
    return _parts(s, d).select("p_partkey", P.recommendation(F.col("has_test"), F.col("cost"), F.col("n")).alias("advice"))


@query("p80_contracts_file", f"{FK}{ROLES} SELECT '# Behavioural contracts' || chr(10) || chr(10) || string_agg(format('- **{{}}**: {{}} nodes, stability {{:.2f}} to {{:.2f}}', role, n, low, high), chr(10) ORDER BY n DESC, role) AS text FROM (SELECT role, count(*) AS n, min(stability) AS low, max(stability) AS high FROM des GROUP BY role)")
def _(s, d):
    return render.contracts_markdown(P.contracts(P.describe(fk_graph(s, d))))


# Source text and logs


@query("p81_risk_rows", f"WITH {SRC_SQL} SELECT id, count(*) AS n FROM (SELECT id, 'async' AS c FROM src WHERE contains(lower(content), 'await ') OR contains(lower(content), 'async def ') UNION ALL SELECT id, 'io' FROM src WHERE contains(lower(content), 'open(') UNION ALL SELECT id, 'dynamic_python' FROM src WHERE contains(lower(content), 'eval(')) GROUP BY id")
def _(s, d):
    return code.risk_signals(sources(s, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("p83_symbol_names", f"WITH {SRC_SQL} SELECT id, unnest([concat('go', id), concat('Big', id), 'run', 'test_it']) AS name FROM src WHERE id % 4 = 1")
def _(s, d):
    return code.python_contract(sources(s, d).where("id % 4 = 1")).where("kind <> 'import'").select("id", "name")


@query("p7_crashed", "SELECT event_id, event_id % 3 > 0 AS crashed FROM events")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", logs.crashed((F.col("event_id") % 3).cast("int")).alias("crashed"))


@query("h5_distinct_errors", "SELECT concat('a', user_id, '.c') AS file, event_id % 100 AS line, count(*) AS scripts FROM events GROUP BY ALL")
def _(s, d):
    """The same error twice in one log counts once, in two logs twice."""
    e = s.read.parquet(f"{d}/events.parquet")
    line = F.concat(F.lit("a"), "user_id", F.lit(".c:"), F.col("event_id") % 100)
    text = F.concat(line, F.lit(":1: error: x\n"), line, F.lit(":9: error: x\n"))
    odd = F.col("event_id") % 2 == 1
    made = e.select(F.col("event_id").cast("string").alias("name"), F.when(odd, text).otherwise("").alias("stdout"), F.when(odd, "").otherwise(text).alias("stderr"))
    return logs.parse_errors(made).groupBy("file", "line").agg(F.count(F.lit(1)).alias("scripts")).withColumn("line", F.col("line").cast("long"))


@query("p84_quality_scripts", table_sql([(1, 2, 1)], "passed, failed, errors"))
def _(s, d):
    ran = scripts.run_scripts(s, [("ok", "true"), ("bad", "echo 'a.c:1:2: error: x'; exit 1"), ("odd", "exit 2")], work_folder(s))
    errors = logs.parse_errors(ran)
    return logs.feedback(ran, errors).select(*[F.col(c).cast("int").alias(c) for c in ("passed", "failed", "errors")])


# Vectors and samplers


@query("l12_own_embedder", f"{FK} SELECT id, length(kind || ' ' || path)::DOUBLE AS x FROM nodes WHERE kind IN ('File', 'Module')")
def _(s, d):
    own = EmbeddingSampler(embed=_lengths)
    return own.vectors(own.selector().matches(fk_graph(s, d).nodes)).select("id", F.get("embedding", 0).cast("double").alias("x"))


def _lengths(texts):
    return [[float(len(t)), 1.0] for t in texts]


@query("m11_embedder", f"{FK} SELECT id, '{{\"model\":\"custom\",\"dim\":2}}' AS artifact FROM nodes WHERE kind IN ('File', 'Module')")
def _(s, d):
    return EmbeddingSampler(embed=_lengths).sample(fk_graph(s, d)).artifacts


LANGUAGE = "CASE regexp_extract(path, '\\.([^./]*)$', 1) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'md' THEN 'markdown' ELSE 'unknown' END"


@query("l13_headers", f"{DOC} SELECT id, kind || ' ' || {LANGUAGE} || ' ' || path AS fast, kind || ' ' || {LANGUAGE} || ' ' || path || CASE WHEN path LIKE '%.py' THEN ' def f' || id || '(): pass' ELSE '' END AS deep FROM nodes WHERE path LIKE '%.py' OR path LIKE '%.md'")
def _(s, d):
    n = doc_graph(s, d).nodes.where("path like '%.py' or path like '%.md'").withColumn("content", F.concat(F.lit("x = 1\ndef f"), "id", F.lit("(): pass")))
    return n.select("id", V.node_header(n).alias("fast"), V.node_header(n, "deep", F.col("content")).alias("deep"))


@query("l14_found_by_meaning", ORACLES["d8_find_by_text"])
def _(s, d):
    return _ops_tools(s, d).call("semantic_search", query="Nation_1", k=30).select("id", "score")


def _indexed_tools(s, d) -> api.Tools:
    """Tools over the graph of the tables, its texts indexed in the shared folder."""
    g, p = fk_graph(s, d), api.Projects()
    p.register(api.Project("fk", g, texts=TextIndex.build(g.nodes, shared(s, "texts"))))
    return api.Tools(s, p)


@query("d5_indexed_search", ORACLES["d5_search_nodes"])
def _(s, d):
    return _indexed_tools(s, d).call("search_nodes", query="Part_1", kind="file", extension="rs").select("id", "name", "path", "total")


@query("d8_indexed_text", ORACLES["d8_find_by_text"])
def _(s, d):
    return _indexed_tools(s, d).call("semantic_search", query="Nation_1", k=30).select("id", "score")


ASKED = "python parser of src1: a file that parses"


@query("l14_ranked_by_meaning", f"""{DOC}, w AS (SELECT id, unnest(regexp_extract_all(lower(kind || ' ' || path), '[\\p{{L}}\\p{{N}}]+')) AS w FROM nodes WHERE kind IN ('File', 'Module') UNION ALL SELECT NULL, unnest(regexp_extract_all(lower('{ASKED}'), '[\\p{{L}}\\p{{N}}]+'))),
p AS (SELECT id, ('0x' || md5(w)[1:7])::BIGINT % 64 AS place, sum(CASE WHEN ('0x' || md5(w)[8:14])::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM w GROUP BY ALL),
v AS MATERIALIZED (SELECT id, place, (x / sqrt(sum(x * x) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM p WHERE x <> 0),
c AS (SELECT a.id, sum(a.x * q.x) / any_value(n) / (SELECT sqrt(sum(x * x)) FROM v WHERE id IS NULL) AS score FROM v a JOIN v q ON q.id IS NULL AND q.place = a.place JOIN (SELECT id, sqrt(sum(x * x)) AS n FROM v GROUP BY id) l ON l.id = a.id GROUP BY a.id)
SELECT id, path, round(score, 6) AS score FROM c JOIN nodes USING (id) WHERE score >= 0.1 ORDER BY round(c.score, 12) DESC, id LIMIT 25""")
def _(s, d):
    g, p = doc_graph(s, d), api.Projects()
    p.register(api.Project("docs", g, index=V.index_nodes(g.nodes, F.concat_ws(" ", "kind", "path"))))
    embed = lambda text: list(s.range(1).select(V.hashed_embedding(F.lit(text)).alias("e")).first()["e"])
    return api.Tools(s, p, embed).call("semantic_search", query=ASKED, k=25, least=0.1).select("id", "path", r6("score"))


@query("p85_run_search", f"{FK} SELECT id FROM nodes WHERE false")
def _(s, d):
    return R.run_search(fk_graph(s, d).nodes, "p").select("id")


class _NameLengths(Sampler):
    id = "lengths"

    def selector(self):
        return R.Selector.predicate(F.col("kind") != "Directory")

    def compute(self, g, selected, annotations):
        return selected.where(F.length("name") > 8).select("id", F.to_json(F.struct(F.length("name").alias("n"))).alias("artifact"))


@query("m1_own_sampler", f"{FK} SELECT id, '{{\"n\":' || length(name) || '}}' AS artifact FROM nodes WHERE kind <> 'Directory' AND length(name) > 8")
def _(s, d):
    return _NameLengths().sample(fk_graph(s, d)).artifacts


@query("p42_sampled", f"{FK} SELECT count(*) AS n FROM nodes WHERE kind <> 'Directory' AND length(name) > 8")
def _(s, d):
    return values(s, [(len(_NameLengths().sample(fk_graph(s, d))),)], "n long")


@query("m4_degree_sampler", ORACLES["f5_degree_json"])
def _(s, d):
    return DegreeSampler().sample(fk_graph(s, d)).artifacts


@query("m12_regions", f"{FK} SELECT split_part(path, '/', 1) AS region, count(*) AS n FROM nodes GROUP BY 1")
def _(s, d):
    return FolderRegions().extract_regions(fk_graph(s, d)).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query("m12_regions_in_sql", f"{FK} SELECT kind, array_to_string(string_split(path, '/')[1:2], '/') AS region, count(*) AS n, min(id) AS first_id FROM nodes GROUP BY ALL")
def _(s, d):
    """The mapper as a table function of SQL, a partition for each kind and shelf of regions."""
    table_functions.register(s)
    nodes = fk_graph(s, d).nodes.select("id", "kind", "path")
    shelved = nodes.withColumn("shelf", table_functions.shelf(F.col("path"), 2, nodes.count()))
    return s.sql("SELECT kind, region, n, first_id FROM regions(TABLE({nodes}) PARTITION BY (kind, shelf), depth => 2, by => 'kind')", nodes=shelved)


@query("n1_changes_in_sql", "SELECT user_id, event_id, event_type AS fingerprint FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)")
def _(s, d):
    table_functions.register(s)
    events = s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "ts", F.col("event_type").alias("fingerprint"))
    return s.sql("SELECT user_id, event_id, fingerprint FROM only_changes(TABLE({e}) PARTITION BY user_id ORDER BY (ts, event_id))", e=events)


@query("p101_no_regions", f"{FK} SELECT '' AS region, id FROM nodes WHERE false")
def _(s, d):
    return NoRegions().extract_regions(fk_graph(s, d))


@query("m13_architects", f"{FK} SELECT count(*) AS n FROM (SELECT DISTINCT name FROM nodes WHERE kind <> 'Directory')")
def _(s, d):
    return fk_graph(s, d).transform(lambda g: T.architect(g, "flat")).nodes.agg(F.count(F.lit(1)).alias("n"))


@query("m14_evaluators", f"{FK} SELECT id FROM nodes WHERE kind = 'Test'")
def _(s, d):
    return fk_graph(s, d).nodes.where(Constitution("c").add_evaluator(F.col("kind") == "Test").allowed()).select("id")


@query("p100_added_evaluators", f"{FK} SELECT count(*) FILTER (id % 2 = 0 AND id % 3 = 0) AS both, count(*) AS every FROM nodes")
def _(s, d):
    none, two = Constitution("c"), Constitution("c").add_evaluator(F.col("id") % 2 == 0).add_evaluator(F.col("id") % 3 == 0)
    return fk_graph(s, d).nodes.agg(F.count_if(two.allowed()).alias("both"), F.count_if(none.allowed()).alias("every"))


@query("m15_scanned_and_tested", table_sql([(0, 8, "test", 0)], "empty, nodes, script, exit_code"))
def _(s, d):
    at = _configured(s)
    with open(os.path.join(at, project.CONFIG_FILE), "w", encoding="utf-8") as f:
        f.write('[scripts]\ntest = "true"\n')
    os.remove(os.path.join(at, "ignore.txt"))
    ran = ScriptRunner().run_tests(s, at).first()
    return values(s, [(EmptyScanner().scan_repo(s, at).nodes.count(), FolderScanner().scan_repo(s, at).nodes.count(), ran["name"], ran["exit_code"])], "empty int, nodes int, script string, exit_code int")


@query("p106_empty_scan", table_sql([(0, 0)], "nodes, edges"))
def _(s, d):
    g = EmptyScanner().scan_repo(s, ".")
    return values(s, [(g.nodes.count(), g.edges.count())], "nodes int, edges int")


@query("p102_applied_changes", table_sql([("a/b.txt", "new"), ("src/lib.rs", "other")], "path, content"))
def _(s, d):
    at = work_folder(s)
    made = values(s, [("a/b.txt", "new"), ("src/lib.rs", "other"), ("data.bin", None)], "path string, content string")
    assert FileMaterializer().apply_proposed_changes(made, at) == 3 and not os.path.exists(at + "/data.bin")
    return values(s, [(p, scan.read_file(at, p)["content"]) for p in ("a/b.txt", "src/lib.rs")], "path string, content string")


# Streams


@query("n3_fan_out", table_sql([("late", 1, None), ("quick", 5, None), ("slow", 3, "lagged: 2 lost")], "client, messages, warning"))
def _(s, d):
    b = C.Broadcast(3)
    b.subscribe("quick")
    b.subscribe("slow")
    quick = []
    for k in range(5):
        if k == 4:
            b.subscribe("late")
        b.send(f"m{k}")
        quick += b.receive("quick")
    rows = [("quick", quick), ("slow", b.receive("slow")), ("late", b.receive("late"))]
    lag = lambda m: m[0] if m[0].startswith("lagged") else None
    return values(s, [(c, len(m) - (lag(m) is not None), lag(m)) for c, m in rows], "client string, messages int, warning string")


PROCESS = "SELECT user_id AS process, event_id AS seq, CASE WHEN event_id % 7 < 2 THEN 'start' WHEN event_id % 7 < 4 THEN 'exit' WHEN event_id % 7 < 6 THEN 'change' ELSE 'kill' END AS event, (event_id % 2)::INT AS exit_code, CASE user_id % 4 WHEN 0 THEN 'never' WHEN 1 THEN 'on_code_change' WHEN 2 THEN 'on_crash' ELSE 'always' END AS policy FROM events"


@query("n6_process_states", f"WITH e AS ({PROCESS}), a AS (SELECT *, event IN ('exit', 'change') AND CASE policy WHEN 'always' THEN true WHEN 'on_code_change' THEN event = 'change' WHEN 'on_crash' THEN event = 'exit' AND exit_code <> 0 ELSE false END AS again FROM e), b AS (SELECT *, CASE WHEN event = 'start' THEN true WHEN event = 'kill' THEN false WHEN event = 'exit' AND NOT again THEN false END AS sets FROM a), c AS (SELECT *, coalesce(last_value(sets IGNORE NULLS) OVER (PARTITION BY process ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was, coalesce(last_value(sets IGNORE NULLS) OVER (PARTITION BY process ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS running FROM b) SELECT process, seq, running, again AND was AS restarted, count(*) FILTER (again AND was) OVER (PARTITION BY process ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS restarts FROM c")
def _(s, d):
    e, k = s.read.parquet(f"{d}/events.parquet"), F.col("event_id") % 7
    event = F.when(k < 2, "start").when(k < 4, "exit").when(k < 6, "change").otherwise("kill")
    policy = F.element_at(F.array(*[F.lit(p) for p in ("never", "on_code_change", "on_crash", "always")]), (F.col("user_id") % 4 + 1).cast("int"))
    return C.process_states(e.select(F.col("user_id").alias("process"), F.col("event_id").alias("seq"), event.alias("event"), (F.col("event_id") % 2).cast("int").alias("exit_code"), policy.alias("policy")))


@query("n10_frame_ring", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 120")
def _(s, d):
    return C.ring(s.read.parquet(f"{d}/events.parquet").select("event_id"), "event_id", 120)


@query("p104_heartbeats", table_sql([(3, 2, 25.0)], "beats, failures, waited"))
def _(s, d):
    answers, waited = iter([True, False, None, True, True]), []

    def beat():
        if (ok := next(answers)) is None:
            raise ConnectionError
        return ok

    beats, failures = C.heartbeat(beat, lambda: len(waited) == 5, waited.append)
    return values(s, [(beats, failures, sum(waited))], "beats int, failures int, waited double")


# Layout and selections


@query("p86_programmatic_selection", f"{FK} SELECT id, 0 AS depth FROM nodes WHERE kind = 'Test'")
def _(s, d):
    n = fk_graph(s, d).nodes
    chosen, depth = selection.apply_programmatic(n, n.where("kind = 'Test'").select("id").unionByName(s.range(3)))
    return chosen.withColumn("depth", F.lit(depth))


@query("p87_frame_skips", "SELECT p_partkey, CASE WHEN p_partkey * 20 < 1000 THEN 1 WHEN p_partkey * 20 < 3000 THEN 2 ELSE 4 END AS skip FROM part")
def _(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", S.frame_skip(F.col("p_partkey") * 20).cast("int").alias("skip"))


@query("p88_epsilons", "SELECT p_partkey, CASE WHEN p_partkey * 20 < 1000 THEN 0.01 WHEN p_partkey * 20 < 3000 THEN 0.05 ELSE 0.1 END::DOUBLE AS epsilon FROM part")
def _(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", S.epsilon(F.col("p_partkey") * 20).alias("epsilon"))


@query("p89_synced_selection", f"{FK} SELECT count(*) AS n, true AS changed, false AS again FROM nodes WHERE kind = 'Directory'")
def _(s, d):
    n = fk_graph(s, d).nodes
    shown = n.where("kind = 'Directory'").select("id")
    own, changed = selection.sync(n.where("kind = 'Test'").select("id"), shown)
    _, again = selection.sync(own, shown.unionByName(shown))
    return own.agg(F.count(F.lit(1)).alias("n"), F.lit(changed).alias("changed"), F.lit(again).alias("again"))


@query("p92_overlaid_activations", f"{FK} SELECT id, CASE WHEN kind = 'Test' THEN 0.7 ELSE 0.2 END::DOUBLE AS activation FROM nodes")
def _(s, d):
    n = fk_graph(s, d).nodes
    new = A.initial_state(n.where("kind = 'Test'"), 0.7)
    return selection.update_activations(n.select("id", F.lit(0.2).alias("activation")), new)


@query("p95_repulsion", f"{DOC}, {PLACES}, e AS (SELECT a.id, a.x - b.x AS dx, a.y - b.y AS dy, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + 0.01 AS d2 FROM p a, p b) SELECT id, round(sum(dx / (sqrt(d2) * d2) * 1000), 5) AS fx, round(sum(dy / (sqrt(d2) * d2) * 1000), 5) AS fy FROM e GROUP BY id")
def _(s, d):
    return L.repulsion(_places(doc_graph(s, d)), L.Config(theta=0.0, depth=20)).select("id", F.round("fx", 5).alias("fx"), F.round("fy", 5).alias("fy"))


def _level_sql(k: int) -> str:
    return f"{FK}, {PLACES}, b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y), 1.0) * 1.1 AS side FROM p) SELECT least({(1 << k) - 1}, floor((x - x0) / side * {1 << k}))::BIGINT AS i, least({(1 << k) - 1}, floor((y - y0) / side * {1 << k}))::BIGINT AS j, count(*) AS mass FROM p, b GROUP BY 1, 2"


@query("p97_quadrants", _level_sql(5))
def _(s, d):
    at = _places(fk_graph(s, d))
    b = L.bounds(at).first()
    return L.cells(at, 5, b["side"], b["x0"], b["y0"]).where("level = 5").select("i", "j", "mass")


@query("p96_octants", f"{FK}, {PLACES}, q AS (SELECT x, y, (id % 1009)::DOUBLE AS z FROM p), b AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z), 1.0) * 1.1 AS side FROM q) SELECT least(7, floor((x - x0) / side * 8))::BIGINT AS i, least(7, floor((y - y0) / side * 8))::BIGINT AS j, least(7, floor((z - z0) / side * 8))::BIGINT AS k, count(*) AS mass FROM q, b GROUP BY 1, 2, 3")
def _(s, d):
    at = _places(fk_graph(s, d)).withColumn("z", (F.col("id") % 1009).cast("double"))
    b = at.agg(*[f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)]).first()
    side = max(*[b[f"max_{a}"] - b[f"min_{a}"] for a in "xyz"], 1.0) * 1.1
    return L3.cells(at, 3, side, tuple(b[f"min_{a}"] for a in "xyz")).where("level = 3").select("i", "j", "k", "mass")


@query("p98_bounds", f"{FK}, {PLACES} SELECT min(x) AS x0, min(y) AS y0, round(greatest(max(x) - min(x), max(y) - min(y), 1.0) * 1.1, 6) AS side FROM p")
def _(s, d):
    return L.bounds(_places(fk_graph(s, d))).select("x0", "y0", r6("side"))


@query("p99_parameters", table_sql([(0.016, 0.9, 1000.0, 0.01, 0.8, 0.1, 12)], "dt, damping, repulsion, attraction, theta, gravity, depth"))
def _(s, d):
    c = L.Config()
    return values(s, [(c.dt, c.damping, c.repulsion, c.attraction, c.theta, c.gravity, c.depth)], "dt double, damping double, repulsion double, attraction double, theta double, gravity double, depth int")
