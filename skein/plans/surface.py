"""Stores, scans, tools and the finer operators, over the driver's tables and folders made for the purpose."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from .. import api
from ..functions import code, scalars as S
from ..operators import automaton as A
from ..operators import degrees as D
from ..operators import joins as J
from ..operators import layout as L
from ..operators import planning as P
from ..operators import search as R
from ..operators import traversal as T
from ..operators import vectors as V
from ..operators.selection import label_visible
from ..session import shared_top
from ..samplers import Constitution, DegreeSampler, EmbeddingSampler, ModelRule, NoOpSampler, resolver_of
from ..sources import project, render, scan, vcs
from ..sources.store import Store, read_graph_json, write_graph_json
from ..streaming import changes as C, liveness
from ..streaming.loop import WatchLoop
from .iterative import ACTION, ALIVE, DESCRIBED, FULL, ITEMS, MIG, ROLES, SEED, SQL, TASK, TOP, _structural_items, living, seeded_ids, ticks_sql
from .projections import doc_graph, fk_graph, fk_sql
from .registry import ORACLES, query, r6
from .relational import BOTH, DEG, DOC, FK, NATION, PART, REGION, STEM, torus
from .textual import LOG_SQL, MEANT, SRC_SQL, log_rows, sources


def shared(s, name: str) -> str:
    """A fresh folder below the session's shared one."""
    return f"{shared_top(s)}/{name}-{uuid.uuid4().hex[:12]}"


def values(s, rows, schema):
    return s.createDataFrame(rows, schema)


def table_sql(rows, names) -> str:
    q = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + f") v({names})"


# Scans: a small work folder

FILES = {"repo/src/lib.rs": "mod util;\n", "repo/src/util.rs": "#[test]\n", "repo/node_modules/x.js": "x", "repo/.hidden/y.py": "y", "repo/app/main.py": "import src\n", "repo/data.bin": "a\x00b", "repo/package.json": '{"scripts": {"test": "jest", "odd": "x"}}', "repo/ignore.txt": "# no\n\n a \nb\n"}


def work_folder(s=None) -> str:
    """In the session's shared folder where that is a plain one, as Spark reads some of the files too."""
    at = shared(s, "scan") if s is not None else ""
    top = at.removeprefix("file://") if at.startswith("file:///") else tempfile.mkdtemp(prefix="skein-scan-")
    for name, text in FILES.items():
        path = os.path.join(top, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return top + "/repo"


SEEN = ["app/main.py", "data.bin", "ignore.txt", "package.json", "src/lib.rs", "src/util.rs"]


@query("a1_scan", table_sql([(p, len(FILES["repo/" + p])) for p in SEEN], "relative_path, size"))
def _(s, d):
    return scan.scan(s, work_folder(s)).select("relative_path", F.col("size").cast("int").alias("size"))


@query("a2_hidden_segments", "SELECT page_id, regexp_matches(url, '/\\.') AS hidden FROM pages")
def _(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", F.exists(F.split("url", "/"), scan.is_hidden).alias("hidden"))


FOLDER = "CASE page_id % 6 WHEN 0 THEN 'target' WHEN 1 THEN '.git' WHEN 2 THEN 'node_modules' WHEN 3 THEN '__pycache__' WHEN 4 THEN 'mine' ELSE 'src' END"


@query("a3_skipped_folders", f"SELECT page_id, page_id % 6 < 5 AS skipped FROM pages")
def _(s, d):
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", scan.is_skipped(F.expr(FOLDER), {"mine"}).alias("skipped"))


@query("a4_scan_with_options", table_sql([("src/lib.rs",), ("src/util.rs",)], "relative_path"))
def _(s, d):
    return scan.scan(s, work_folder(s), options=scan.ScanOptions(extensions={"rs"}, max_size=100)).select("relative_path")


@query("a7_expanded_content", table_sql([(p, None if p == "data.bin" else FILES["repo/" + p]) for p in SEEN], "relative_path, content").replace("\n", "' || chr(10) || '"))
def _(s, d):
    return scan.with_content(s, scan.scan(s, work_folder(s))).select("relative_path", "content")


@query("a8_text_sources", table_sql([(p, p != "data.bin") for p in SEEN], "relative_path, is_text"))
def _(s, d):
    return scan.with_content(s, scan.scan(s, work_folder(s))).select("relative_path", F.col("content").isNotNull().alias("is_text"))


REMOTES = ["./x", "/abs", "acme", "https://github.com/acme/tool.git", "git@github.com:acme/tool"]


@query("a15_sync_sources", table_sql([("./x", "local", None), ("/abs", "local", None), ("acme", "org", "acme"), (REMOTES[3], "repo", "acme"), (REMOTES[4], "repo", "acme")], "value, type, org"))
def _(s, d):
    return values(s, [(v, scan.sync_source(v)["type"], scan.sync_source(v).get("org")) for v in REMOTES], "value string, type string, org string")


@query("a16_remotes", table_sql([("acme", "https://github.com/acme", True), (REMOTES[4], "https://github.com/acme/tool", False)], "value, url, is_org"))
def _(s, d):
    return values(s, [(v, scan.remote_info(v)["url"], scan.remote_info(v)["is_org"]) for v in ("acme", REMOTES[4])], "value string, url string, is_org boolean")


@query("a14_workspace", table_sql([("plain",)], "kind"))
def _(s, d):
    return values(s, [(scan.workspace(work_folder(s))["kind"],)], "kind string")


@query("a30_project_type", table_sql([("node", "test", "npm run test")], "type, script, command"))
def _(s, d):
    w = work_folder(s)
    return values(s, [(project.detect_type(w), k, v) for k, v in project.infer(w).scripts.items()], "type string, script string, command string")


@query("a32_package_scripts", table_sql([("test", "npm run test")], "name, command"))
def _(s, d):
    return values(s, list(project.package_scripts(work_folder(s)).items()), "name string, command string")


@query("a37_ignore_list", table_sql([("a",), ("b",), ("c",)], "name"))
def _(s, d):
    return scan.ignore_list(s, ["c", ""], "file://" + work_folder(s) + "/ignore.txt")


@query("a38_read_file", table_sql([("src/lib.rs", 2, "rust")], "path, lines, language"))
def _(s, d):
    r = scan.read_file(work_folder(s), "src/lib.rs")
    return values(s, [(r["path"], r["lines"], r["language"])], "path string, lines int, language string")


@query("a36_sample_graph", table_sql([("src", 0, 3), ("src/lib.rs", 1, 1), ("src/parser.rs", 3, 0), ("src/parser_test.rs", 1, 1)], "path, ins, outs"))
def _(s, d):
    from ..operators.degrees import degrees

    g = T.sample_graph(s)
    return degrees(g).join(g.nodes, "id").select("path", F.col("in_degree").cast("int").alias("ins"), F.col("out_degree").cast("int").alias("outs"))


STATUS = "MM a\0R  new\0old\0?? c\0"


@query("a23_status_rows", table_sql([("a", "Modified", True), ("a", "Modified", False), ("new", "RenamedTo", True), ("c", "Untracked", False)], "path, kind, staged"))
def _(s, d):
    return values(s, vcs.status_rows(STATUS), vcs.CHANGES)


@query("a25_diff_counts", table_sql([(1, 2, 1)], "files, insertions, deletions"))
def _(s, d):
    return values(s, [("diff --git a b\n--- a\n+++ b\n-x\n+y\n+z\n",)], "patch string").select(*vcs.diff_counts("patch"))


@query("p76_absolute_paths", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '/x' ELSE '/w/x' END AS path FROM events")
def _(s, d):
    p = F.when(F.col("event_id") % 2 == 0, "/x").otherwise("x")
    return vcs.absolute(s.read.parquet(f"{d}/events.parquet").select("event_id", p.alias("path")), "/w")


# Stores


@query("b3_graph_round_trip", f"{FK} SELECT src, dst, relationship FROM edges")
def _(s, d):
    st = Store(s, shared(s, "store"))
    st.save_graph(fk_graph(s, d))
    return st.load_graph().edges.select("src", "dst", "relationship")


@query("a18_graph_json", f"{FK} SELECT 'node' AS what, id AS a, NULL::BIGINT AS b, path AS text FROM nodes UNION ALL SELECT 'edge', src, dst, relationship FROM edges")
def _(s, d):
    """The whole graph as one document, written in pieces and read in splits."""
    at = shared(s, "graph")
    write_graph_json(fk_graph(s, d), at)
    g = read_graph_json(s, at)
    return g.nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("path").alias("text")).unionByName(g.edges.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relationship").alias("text")))


@query("b2_stripped_sources", "SELECT doc_id, source FROM documents")
def _(s, d):
    st = Store(s, shared(s, "store"))
    st.save_project(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", F.col("text").alias("content")))
    return st.load("project")


@query("b4_snapshots", table_sql([(3000, 3), (2000, 2)], "taken, n"))
def _(s, d):
    st = Store(s, shared(s, "store"))
    for at in (1000, 3000, 2000):
        st.snapshot("state", s.range(at // 1000), at)
    st.prune("state", 2)
    return values(s, [(at, st.load_snapshot("state", at).count()) for at in st.snapshots("state")], "taken int, n int")


@query("p32_latest_snapshot", table_sql([(3,)], "rows"))
def _(s, d):
    st = Store(s, shared(s, "store"))
    for at in (1000, 3000):
        st.snapshot("state", s.range(at // 1000), at)
    return st.load_snapshot("state").agg(F.count(F.lit(1)).cast("int").alias("rows"))


@query("b9_vector_store", "SELECT vec_id AS id, 'hash' AS model FROM embeddings")
def _(s, d):
    st = Store(s, shared(s, "store"))
    st.save_vectors(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding"), "hash", 64)
    index, meta = st.load_vectors()
    return index.select("id", F.lit(meta["model"]).alias("model"))


@query("b14_event_log", table_sql([("graph_updated", '{"n": 1}'), ("error", "{}")], "type, payload"))
def _(s, d):
    st = Store(s, shared(s, "store"))
    st.append_event("graph_updated", {"n": 1})
    st.append_event("error", {})
    return st.events().select("type", "payload")


@query("b16_toml", table_sql([('[project]\nname = "p"\n\n[scripts]\na = "y"\nb = "x"\n',)], "text").replace("\n", "' || chr(10) || '"))
def _(s, d):
    return values(s, [(project.to_toml(project.ProjectConfig("p", {"b": "x", "a": "y"})),)], "text string")


@query("b11_markdown", "SELECT source || '/' || doc_id || '.txt' AS relative_path, '## ' || source || '/' || doc_id || '.txt' || chr(10) || chr(10) || '```txt' || chr(10) || text || chr(10) || '```' || chr(10) AS text FROM documents")
def _(s, d):
    p = F.concat("source", F.lit("/"), "doc_id", F.lit(".txt"))
    docs = s.read.parquet(f"{d}/documents.parquet").select(p.alias("relative_path"), p.alias("name"), F.col("text").alias("content"))
    return render.sources_markdown(docs)


LINE = "chr(10)"


@query("p13_impact_markdown", f"{SQL}{ROLES}{ticks_sql(DESCRIBED, FULL, 1)}, r AS (SELECT id, path, role, a, CASE WHEN a >= 0.7 THEN 'High' WHEN a >= 0.3 THEN 'Medium' ELSE 'Low' END AS level FROM s1 JOIN des USING (id) WHERE a >= 0.05 ORDER BY a DESC, id LIMIT 50) SELECT '# Impact' || {LINE} || {LINE} || '| path | role | level | activation |' || {LINE} || '|-|-|-|-|' || {LINE} || string_agg(printf('| %s | %s | %s | %.3f |', path, role, level, a), {LINE} ORDER BY a DESC, id) AS text FROM r")
def _(s, d):
    g = fk_graph(s, d)
    desc = P.describe(g)
    return render.impact_markdown(P.impact_report(desc, A.with_description(g, desc, g.nodes.where(seeded_ids())).run_ticks(1).state))


@query("p14_plan_markdown", f"{FK}{ITEMS}, {TOP} 30), k AS (SELECT count(*) AS below, avg(gap) AS ag, (SELECT count(*) FROM nodes) AS total FROM items), h AS (SELECT *, greatest(0, least(1, 1 - ag * below / total)) AS health FROM k), lines AS (SELECT string_agg(printf('| %s | %s | %.3f | %.3f | %s |', path, role, gap, priority, action), {LINE} ORDER BY priority DESC, gap DESC, in_degree DESC, path, id) AS t FROM top) SELECT '# Plan' || {LINE} || {LINE} || 'Health [' || repeat('#', round(health * 20)::INT) || repeat('.', 20 - round(health * 20)::INT) || ']' || printf(' %.0f %%, %d of %d below target', health * 100, below, total) || {LINE} || {LINE} || '| path | role | gap | priority | action |' || {LINE} || '|-|-|-|-|-|' || {LINE} || t AS text FROM h, lines")
def _(s, d):
    items, g = _structural_items(s, d)
    return render.plan_markdown(items, P.summary(items, g.nodes.count()))


STEPS = "CASE " + TASK.removeprefix("CASE ").replace("'AddTests'", "['read the public functions', 'write a test for each behaviour', 'run the test suite']").replace("'AddDocs'", "['list contracts and invariants', 'document them', 'review examples']").replace("'ReduceCoupling'", "['find callers', 'extract an interface', 'move callers to it']").replace("'Refactor'", "['find the parts', 'simplify them', 'run the checks']")


@query("p15_task_markdown", f"{FK}{ITEMS}, {TOP} 1), st AS (SELECT *, {STEPS} AS steps FROM top) SELECT printf('# %s', action) || {LINE} || {LINE} || printf('%s (%s, gap %.3f)', path, role, gap) || {LINE} || {LINE} || '1. ' || steps[1] || {LINE} || '2. ' || steps[2] || {LINE} || '3. ' || steps[3] || {LINE} AS text FROM st")
def _(s, d):
    items, g = _structural_items(s, d)
    return render.task_markdown(P.next_task(items, g))


# Projections and predicates

NODE_SQL = [
    ("c21_node_info", "SELECT id, name, lower(kind) AS kind, path FROM nodes", lambda g: R.node_info(g.nodes)),
    ("c23_node_paths", "SELECT id, path FROM nodes", lambda g: g.nodes.select("id", R.node_path(g.nodes).alias("path"))),
    ("c29_node_texts", "SELECT id, kind || ' rust ' || path AS text FROM nodes WHERE kind <> 'Directory'", lambda g: g.nodes.where("kind <> 'Directory'").select("id", code.node_text(F.col("kind"), S.language("path"), F.col("path")).alias("text"))),
    ("d2_activate_where", "SELECT id, CASE WHEN kind = 'Test' THEN 0.8 ELSE 0.0 END::DOUBLE AS activation FROM nodes", lambda g: A.seeded(A.initial_state(g.nodes.select("id", "kind")).join(g.nodes.select("id", "kind"), "id"), F.col("kind") == "Test", 0.8).select("id", "activation")),
    ("d19_allowed_changes", "SELECT id FROM nodes WHERE kind = 'File' AND id % 2 = 0", lambda g: g.nodes.where(Constitution("c").add_evaluator(F.col("kind") == "File").add_evaluator(F.col("id") % 2 == 0).allowed()).select("id")),
    ("d20_visible_labels", "SELECT id FROM nodes WHERE kind = 'Directory' OR id % 100 < 30", lambda g: g.nodes.where(label_visible("all", F.col("id") % 100, F.col("kind") == "Directory", most=30)).select("id")),
    ("e23_find_target", f"SELECT id, path FROM nodes WHERE path = 'parts/part_9.rs' OR ends_with(path, '/part_9.rs') ORDER BY id LIMIT 1", lambda g: R.find_by_path(g.nodes, "part_9.rs").select("id", "path")),
    ("e25_adjacency_lists", "SELECT src AS id, 'out' AS direction, count(*) AS n, arg_min(dst, (pos, dst)) AS first FROM edges GROUP BY src UNION ALL SELECT dst, 'in', count(*), arg_min(src, (pos, src)) FROM edges GROUP BY dst", lambda g: J.adjacency_lists(g.edges, g.parts())),
    ("f4_plan_in_degrees", "SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY dst", lambda g: D.in_degrees(g.edges)),
    ("h4_all_nodes", "SELECT id FROM nodes", lambda g: R.all_nodes(g.nodes)),
    ("i12_initial_states", "SELECT id, 0.0::DOUBLE AS activation, false AS changed FROM nodes", lambda g: A.initial_state(g.nodes).select("id", "activation", "changed")),
    ("j18_overwritten_states", "SELECT id, 0.5::DOUBLE AS activation FROM nodes", lambda g: A.seeded(A.initial_state(g.nodes), F.lit(True), 0.5).select("id", "activation")),
    ("l10_embeddable", "SELECT id FROM nodes WHERE kind IN ('File', 'Module')", lambda g: EmbeddingSampler().selector().matches(g.nodes).select("id")),
    ("m3_noop_sampler", "SELECT id, '' AS artifact FROM nodes WHERE false", lambda g: NoOpSampler().sample(g).artifacts),
    ("m6_sample_count", "SELECT count(*) AS n FROM nodes WHERE kind = 'File'", lambda g: DegreeSampler().sample(g).artifacts.agg(F.count(F.lit(1)).alias("n"))),
    ("p22_get_node", f"SELECT id, name FROM nodes WHERE id = {NATION + 1}", lambda g: R.get_node(g.nodes, NATION + 1).select("id", "name")),
    ("p29_containers", "SELECT id, kind IN ('Directory', 'Module') AS container FROM nodes", lambda g: g.nodes.select("id", R.is_container(F.col("kind")).alias("container"))),
    ("p44_edge_count", "SELECT count(*) AS n FROM edges", lambda g: D.edge_count(g.edges)),
    ("p45_node_id", "SELECT id FROM nodes WHERE path = 'region_1'", lambda g: R.node_id(g.nodes, "region_1")),
    ("p55_health", "SELECT 'ok' AS status, (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count", None),
    ("p90_state_activations", "SELECT id, 0.0::DOUBLE AS activation FROM nodes", lambda g: A.initial_state(g.nodes).select("id", "activation")),
    ("p93_visuals", "SELECT id, name AS label, kind FROM nodes", lambda g: g.nodes.select("id", S.display_label(F.col("path"), F.col("name"), F.col("id")).alias("label"), "kind")),
    ("c38_node_radius", "SELECT kind, CASE WHEN count(*) < 1000 THEN 8.0 WHEN count(*) < 3000 THEN 6.0 ELSE 4.0 END::DOUBLE AS radius FROM nodes GROUP BY kind", lambda g: g.nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", S.node_radius(F.col("n")).alias("radius"))),
    ("c49_shortened_prefixes", "SELECT id, CASE WHEN starts_with(path, 'parts/') THEN substr(path, 7) ELSE path END AS short FROM nodes", lambda g: g.nodes.select("id", S.shorten_path(F.col("path"), "parts").alias("short"))),
    ("p91_activation_colours", "SELECT id, round(255 * least(1.0, 2 * t))::INT AS r, round(255 * least(1.0, 2 * (1 - t)))::INT AS g FROM (SELECT id, (id % 11) / 10.0::DOUBLE AS t FROM nodes)", lambda g: g.nodes.select("id", L.colour(F.col("id") % 11 / 10.0).alias("c")).select("id", "c.r", "c.g")),
    ("p25_annotations", "SELECT id, 'x' AS a, kind AS k FROM nodes", lambda g: g.nodes.select("id", S.annotate(S.annotate(F.create_map(F.lit("k"), F.lit("old")), "k", F.col("kind")), "a", F.lit("x")).alias("m")).select("id", F.col("m")["a"].alias("a"), F.col("m")["k"].alias("k"))),
]


def _enter(name, sql, make):
    def run(s, d):
        g = fk_graph(s, d)
        if make is None:
            p = api.Projects()
            p.register(api.Project("fk", g))
            return api.Tools(s, p).resource("health").select("status", "node_count", "edge_count")
        return make(g)

    query(name, f"{FK} {sql}")(run)


for _row in NODE_SQL:
    _enter(*_row)


@query("c26_payloads", f"{FK}{DEG} SELECT id, in_degree, out_degree, CASE WHEN id % 2 = 0 THEN id % 1000 END::BIGINT AS loc FROM deg")
def _(s, d):
    from ..operators.degrees import degrees

    raw = F.when(F.col("id") % 2 == 0, (F.col("id") % 1000).cast("string")).otherwise("many")
    return degrees(fk_graph(s, d)).select("id", "in_degree", "out_degree", raw.try_cast("long").alias("loc"))


@query("c25_role_rules", f"{FK}{ROLES} SELECT role, rule, count(*) AS n FROM des JOIN (VALUES ('entry_point', 'keep the public surface stable'), ('hub', 'damp changes by stability'), ('directory_container', 'follow the children'), ('utility_propagation', 'pass changes on'), ('identity', 'keep the state'), ('sink', 'absorb changes')) v(role, rule) USING (role) GROUP BY ALL")
def _(s, d):
    return P.describe(fk_graph(s, d)).join(P.default_rules_table(s), "role").groupBy("role", "rule").agg(F.count(F.lit(1)).alias("n"))


MARKED = "concat('import a', doc_id, chr(10), '# note', chr(10), 'x = 1', chr(10), 'def f', doc_id, '(): pass', chr(10), 'class C: pass')"


@query("c28_language_markers", "SELECT doc_id, concat('import a', doc_id, chr(10), '# note', chr(10), 'def f', doc_id, '(): pass', chr(10), 'class C: pass') AS excerpt FROM documents")
def _(s, d):
    """A line of each kind that a language's markers tell apart, and one of none."""
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", code.excerpt(F.expr(MARKED), F.lit("python")).alias("excerpt"))


@query("c36_short_languages", table_sql([("Dockerfile", "dockerfile"), ("a.py", "python"), ("x.unknown", "txt")], "name, language"))
def _(s, d):
    top = tempfile.mkdtemp()
    rows = []
    for n in ("Dockerfile", "a.py", "x.unknown"):
        open(os.path.join(top, n), "w").close()
        rows.append((n, scan.read_file(top, n)["language"]))
    return values(s, rows, "name string, language string")


@query("c48_repo_count", "SELECT count(DISTINCT source) AS repos FROM documents")
def _(s, d):
    """Files of the documents, each source a repository, and a repository that has no file."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    paths = docs.select(F.concat(F.lit("w/"), "source", F.lit("/"), "doc_id", F.lit(".rs")).alias("path"))
    roots = docs.select(F.concat(F.lit("w/"), "source").alias("root")).distinct().unionByName(docs.limit(1).select(F.lit("w/none").alias("root")))
    return vcs.count_repos(paths, roots).select(F.col("repos").cast("long").alias("repos"))


@query("c30_python_names", f"WITH {SRC_SQL}, l AS (SELECT trim(unnest(string_split(content, chr(10)))) AS x FROM src WHERE path LIKE '%.py') SELECT trim(regexp_extract(x, '^(?:async def|def|class) ([^(:]*)', 1)) AS name FROM l WHERE regexp_matches(x, '^(async def|def|class) ')")
def _(s, d):
    return code.python_contract(sources(s, d).where("path like '%.py'")).where("kind <> 'import'").select("name")


@query("c8_all_references", f"WITH {SRC_SQL} SELECT 'imports' AS kind, 2 * count(*) FILTER (id % 4 > 0) AS n FROM src UNION ALL SELECT 'uses', count(*) FILTER (id % 4 = 0) * 4 + count(*) FILTER (id % 4 = 3) * 3 FROM src")
def _(s, d):
    return code.reference_rows(sources(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("e7_reference_edges", f"WITH {SRC_SQL}, {MEANT} SELECT DISTINCT source_id AS src, target_id AS dst FROM meant")
def _(s, d):
    src = sources(s, d)
    return J.resolve_routes(code.reference_rows(src), src.select("id", F.col("id").alias("pos"), "path")).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).distinct()


@query("c51_merged_feedback", f"WITH {LOG_SQL} SELECT name FROM log UNION ALL SELECT 'crash'")
def _(s, d):
    from ..functions.logs import merge_crash

    return merge_crash(log_rows(s, d).select("name"), values(s, [("crash",)], "name string"))


# Automaton details


def _auto(s, d, rules):
    g = fk_graph(s, d).cut()
    return A.Automaton(g, rules, A.initial_state(g.nodes, F.when(seeded_ids(), 1.0).otherwise(0.0), seeded_ids()))


@query("j1_tick_counts", f"{SQL}{ticks_sql(SEED, ['import'], 1)} SELECT count(*) FILTER (moved) AS transitions, count(*) FILTER (NOT moved) AS skipped FROM s1")
def _(s, d):
    return _auto(s, d, A.Registry(A.ImportPropagation())).run_ticks(1).ticks().select("transitions", "skipped")


@query("j5_fired_rules", f"{SQL}{ticks_sql(SEED, ['import'], 1)} SELECT id, CASE WHEN moved THEN 'import_propagation' END AS fired FROM s1")
def _(s, d):
    run = _auto(s, d, A.Registry(A.ImportPropagation()))
    return A.evaluate(run.state, run.adjacency, run.rules.by_priority()).select("id", "fired")


@query("j6_contexts", f"{SQL}{ticks_sql(SEED, ['import'], 1)} SELECT id, n0 AS n_all, round(mx, 6) AS max_all, ni AS n_contains FROM m0")
def _(s, d):
    run = _auto(s, d, A.Registry(A.ImportPropagation()))
    return A.messages(run.adjacency, run.state).select("id", "n_all", r6("max_all"), "n_contains")


@query("j7_delegated", f"{SQL}{ticks_sql(SEED, ['module'], 1)} SELECT id, round(a, 6) AS activation FROM s1")
def _(s, d):
    return _auto(s, d, A.Registry(A.Delegate(F.coalesce(F.col("n_contains") > 0, F.lit(False)), A.ModuleActivation()))).run_ticks(1).state.select("id", r6("activation"))


@query("j14_noop_rule", f"{FK} SELECT count(*) AS transitions FROM nodes")
def _(s, d):
    return _auto(s, d, A.Registry(A.NoOp())).run_ticks(1).ticks().select("transitions")


@query("j15_composite_rule", f"{SQL}{ticks_sql(SEED, ['import', 'module'], 2)} SELECT id, round(a, 6) AS activation FROM s2")
def _(s, d):
    return _auto(s, d, A.Registry(A.Composite([A.ModuleActivation(), A.ImportPropagation()]))).run_ticks(2).state.select("id", r6("activation"))


@query("p21_apply_rule", f"{SQL}{ticks_sql(SEED, ['import'], 1, t=-1.0)} SELECT s1.id, round(CASE WHEN m0.id IS NULL THEN s0.a * 0.7 ELSE s1.a END, 6) AS activation FROM s1 JOIN s0 USING (id) LEFT JOIN m0 ON m0.id = s1.id")
def _(s, d):
    run = _auto(s, d, A.Registry(A.ImportPropagation()))
    return A.apply_rule(run.state, run.adjacency, run.rules, "import_propagation").select("id", r6("activation"))


GUARDS = {"p8": ("import", A.ImportPropagation, "mx >= 0.1"), "p9": ("module", A.ModuleActivation, "ni > 0"), "p10": ("proximity", A.ChangeProximity, "s0.ch OR nch"), "p11": ("damped", A.DampedPropagation, "s0.a > 0.01 OR mx > 0.01")}
for _id, (_name, _class, _cond) in GUARDS.items():

    def _guard(s, d, c=_class):
        run = _auto(s, d, A.Registry(c()))
        return run.state.join(A.messages(run.adjacency, run.state), "id", "left").where(c().guard()).select("id")

    query(f"{_id}_{_name}_guard", f"{SQL}{ticks_sql(SEED, [_name], 1)} SELECT s0.id FROM s0 LEFT JOIN m0 ON m0.id = s0.id WHERE coalesce({_cond}, false)")(_guard)


@query("p40_neighbours_with_repeats", f"{FK}{BOTH} SELECT id, count(*) AS n FROM both_ways GROUP BY id")
def _(s, d):
    return fk_graph(s, d).both_ways().groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("p36_prompts", f"{SQL} SELECT nodes.id, count(peer) AS n FROM nodes LEFT JOIN adj ON adj.id = nodes.id GROUP BY nodes.id")
def _(s, d):
    run = _auto(s, d, A.Registry())
    p = ModelRule(lambda x: x).prompts(run.graph, run.state)
    return p.select("id", F.get_json_object("prompt", "$.neighbors.n").cast("long").alias("n"))


@query("j27_model_tick", f"{FK} SELECT id, 0.25::DOUBLE AS activation FROM nodes")
def _(s, d):
    run = _auto(s, d, A.Registry())
    return ModelRule(_quarter).tick(run.graph, run.state).select("id", "activation")


def _quarter(prompts):
    return ['{"activation": 0.25}' for _ in prompts]


@query("j30_unreadable_answers", f"{FK} SELECT id, CASE WHEN id % 37 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS activation, 'unreadable answer' AS feedback FROM nodes")
def _(s, d):
    run = _auto(s, d, A.Registry())
    return ModelRule(lambda prompts: ["?" for _ in prompts]).tick(run.graph, run.state)


@query("j31_engine", f"{SQL}{ticks_sql(SEED, ['proximity', 'import', 'module'], 1)} SELECT id, round(a, 6) AS activation FROM s1")
def _(s, d):
    g = fk_graph(s, d)
    e = api.Engine(g)
    e.apply_intent("touch", g.nodes.where(seeded_ids()))
    e.tick()
    return e.snapshot()[1].select("id", r6("activation"))


@query("j29_round_robin", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) % 3 AS resolver FROM events")
def _(s, d):
    return resolver_of(s.read.parquet(f"{d}/events.parquet").select("event_id"), "event_id", 3)


@query("d17_evolved", "SELECT user_id AS id FROM events GROUP BY user_id HAVING count(*) > 1")
def _(s, d):
    return C.evolved(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id")))


@query("d15_stale", "SELECT user_id, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) > 86400000000 AS stale FROM events GROUP BY user_id")
def _(s, d):
    last = s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max("ts").alias("at"))
    return last.select("user_id", C.is_stale(F.col("at"), F.lit("2024-01-31"), 86400).alias("stale"))


@query("g15_transition_rates", "SELECT user_id, round(count(*) FILTER (event_type = 'click') / count(*)::DOUBLE, 6) AS rate FROM events GROUP BY user_id")
def _(s, d):
    c = s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("transitions"), F.count_if(F.col("event_type") != "click").alias("skipped"))
    return c.select("user_id", r6(A.transition_rate(), "rate"))


@query("g12_ring_buffer", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 200")
def _(s, d):
    return C.ring(s.read.parquet(f"{d}/events.parquet").select("event_id"), "event_id", 200)


@query("h8_changed_sets", "SELECT a.user_id FROM (SELECT user_id, list_sort(list_distinct(list(event_type))) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1) a JOIN (SELECT user_id, list_sort(list_distinct(list(event_type))) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) b USING (user_id) WHERE a.v <> b.v")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    half = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(S.change_fingerprint("event_type").alias(f"f{k}"))
    return half(0).join(half(1), "user_id").where("f0 <> f1").select("user_id")


# Planning details

PLAN = f"{FK}{ITEMS}"


@query("k3_descriptions", f"{FK}{ROLES} SELECT id, name, role, round(stability, 6) AS stability, in_degree, out_degree FROM des")
def _(s, d):
    return P.describe(fk_graph(s, d)).select("id", "name", "role", r6("stability"), "in_degree", "out_degree")


@query("k7_effective_stability", f"{FK} SELECT id, CASE WHEN id % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS stability, CASE WHEN id % 3 = 0 THEN 'own' ELSE 'identity' END AS rule, 'inherit' AS inheritance FROM nodes")
def _(s, d):
    n = fk_graph(s, d).nodes
    config = n.select("id", F.when(F.col("id") % 2 == 0, 0.9).alias("stability"), F.when(F.col("id") % 3 == 0, "own").alias("rule"), F.lit(None).cast("string").alias("inheritance"))
    return P.effective(n, config)


@query("k13_task_kinds", f"{PLAN}, a AS (SELECT lower({ACTION}) AS x FROM items) SELECT CASE WHEN contains(x, 'test') THEN 'AddTests' WHEN contains(x, 'document') THEN 'AddDocs' WHEN contains(x, 'coupling') OR contains(x, 'interface') OR contains(x, 'extract') THEN 'ReduceCoupling' ELSE 'Refactor' END AS kind, count(*) AS n FROM a GROUP BY 1")
def _(s, d):
    items, _ = _structural_items(s, d)
    return items.groupBy(S.task_action(F.col("action")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("g3_plan_order", f"{PLAN} SELECT id, row_number() OVER (ORDER BY round(0.6 * structural, 9) DESC, round(gap, 9) DESC, in_degree DESC, path, id) AS rank FROM items QUALIFY rank <= 30")
def _(s, d):
    items, _ = _structural_items(s, d)
    i = items.withColumns({"priority": F.round("priority", 9), "gap": F.round("gap", 9)})
    order = (F.desc("priority"), F.desc("gap"), F.desc("in_degree"), F.asc("path"), F.asc("id"))
    return J.ranked(i.orderBy(*order).limit(30), *order).select("id", F.col("rank").cast("long").alias("rank"))


@query("f19_weighted_gap", f"{PLAN} SELECT round(coalesce(sum(gap), 0) / (SELECT count(*) FROM nodes), 6) AS weighted FROM items")
def _(s, d):
    items, g = _structural_items(s, d)
    return P.quality(items, g.nodes.count()).select(r6("weighted_gap", "weighted"))


@query("k18_scores", f"{MIG} SELECT id, round(cost, 6) AS cost, strategy FROM fin")
def _(s, d):
    return P.migration_candidates(doc_graph(s, d)).select("id", r6("cost"), "strategy")


@query("f17_repo_classes", f"{DOC} SELECT split_part(path, '/', 1) AS repo, CASE WHEN count(*) FILTER (path LIKE '%.py') > 0 AND count(*) FILTER (path LIKE '%.rs') > 0 THEN 'mixed' WHEN count(*) FILTER (path LIKE '%.py') > 0 THEN 'python' WHEN count(*) FILTER (path LIKE '%.rs') > 0 THEN 'rust' ELSE 'other' END AS class FROM nodes WHERE kind <> 'Directory' GROUP BY 1")
def _(s, d):
    g = doc_graph(s, d)
    return P.repo_summary(g, P.migration_candidates(g), F.split_part("path", F.lit("/"), F.lit(1))).select("repo", "class")


@query("k22_inspection", f"{MIG}, one AS (SELECT * FROM fin ORDER BY id LIMIT 1), u AS (SELECT count(DISTINCT path) AS n FROM edges JOIN nodes ON nodes.id = dst WHERE src = (SELECT id FROM one) AND relationship <> 'contains'), b AS (SELECT count(DISTINCT path) AS n FROM edges JOIN nodes ON nodes.id = src WHERE dst = (SELECT id FROM one) AND relationship <> 'contains'), ts AS (SELECT count(DISTINCT t.id) AS n FROM t WHERE t.id IN (SELECT src FROM edges WHERE dst = (SELECT id FROM one)) OR contains(t.path, (SELECT {STEM} FROM one))) SELECT id, path, in_degree, out_degree, has_test, round(impact, 6) AS impact, round(cost, 6) AS cost, round(roi, 6) AS roi, strategy, u.n AS dependencies, b.n AS dependents, ts.n AS tests, CASE WHEN NOT has_test THEN 'port tests first' WHEN cost >= 0.7 THEN 'defer' WHEN b.n > 5 THEN 'shadow behind the old interface' ELSE 'move as a helper' END AS recommendation FROM one, u, b, ts")
def _(s, d):
    g = doc_graph(s, d).cut()
    row = api.migration_inspection(g, P.migration_candidates(g).orderBy("id").first()["id"])
    return row.drop("reason").withColumns({c: F.round(c, 6) for c in ("impact", "cost", "roi")})


@query("p82_unique_names", f"{DOC}, n AS (SELECT id, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS ident FROM nodes) SELECT id, CASE WHEN k > 1 THEN ident || '_' || k ELSE ident END AS ident FROM (SELECT id, ident, row_number() OVER (PARTITION BY ident ORDER BY id) AS k FROM n)")
def _(s, d):
    from pyspark.sql import Window

    n = doc_graph(s, d).nodes.select("id", S.identifier(F.col("name")).alias("i"))
    k = F.row_number().over(Window.partitionBy("i").orderBy("id"))
    return n.withColumn("k", k).select("id", F.when(F.col("k") > 1, F.concat("i", F.lit("_"), "k")).otherwise(F.col("i")).alias("ident"))


# Tools


def _tools(s, d):
    p = api.Projects()
    p.register(api.Project("fk", fk_graph(s, d)))
    return api.Tools(s, p)


@query("p68_tool_search", ORACLES["d5_search_nodes"])
def _(s, d):
    return _tools(s, d).call("search_nodes", query="Part_1", kind="file", extension="rs").select("id", "name", "path", "total")


@query("p68_tool_impact", f"{FK}, a AS (SELECT src AS id FROM edges WHERE dst = {PART + 4} AND relationship <> 'contains'), b AS (SELECT src AS id FROM edges WHERE dst IN (SELECT id FROM a) AND relationship <> 'contains') SELECT DISTINCT id FROM (SELECT id FROM a UNION ALL SELECT id FROM b)")
def _(s, d):
    """What depends on part 4, whose path follows from its size."""
    tools = _tools(s, d)
    own = R.get_node(tools.projects.resolve().graph.nodes, PART + 4).select("path")
    return tools.call("impact_analysis", paths=[r.path for r in own.collect()]).select("id")


@query("p68_tool_dependencies", f"{FK} SELECT direction, n.id FROM (SELECT 'in' AS direction, src AS id FROM edges WHERE dst = {REGION} UNION ALL SELECT 'out', dst FROM edges WHERE src = {REGION}) e JOIN nodes n USING (id)")
def _(s, d):
    return _tools(s, d).call("get_dependencies", path="region_0").select("direction", "id")


@query("p69_resource_edges", f"{FK} SELECT src, dst FROM edges")
def _(s, d):
    return _tools(s, d).resource("graph/edges").select("src", "dst")


@query("p65_list_projects", table_sql([("fk",)], "name"))
def _(s, d):
    return _tools(s, d).call("list_projects")


@query("l15_semantic_fallback", f"{FK} SELECT id, CASE WHEN lower(name) = 'region_1' THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM nodes WHERE contains(lower(name), 'region_1') OR contains(lower(path), 'region_1') ORDER BY score DESC, id LIMIT 10")
def _(s, d):
    return _tools(s, d).call("semantic_search", query="region_1").select("id", "score")


@query("l6_semantic_search", "WITH s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)) AS score FROM embeddings) SELECT id, round(score, 6) AS score FROM s WHERE s.score >= 0.1 ORDER BY s.score DESC, id LIMIT 10")
def _(s, d):
    index = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    p = api.Projects()
    p.register(api.Project("e", api.Graph(index.select("id"), fk_graph(s, d).edges), index=index))
    q = [float(x) for x in index.where("id = 1").first()["embedding"]]
    return api.Tools(s, p, lambda text: q).call("semantic_search", query="x", least=0.1).select("id", r6("score"))


@query("l11_zero_embedder", table_sql([(0,)], "hits"))
def _(s, d):
    zero = s.range(3).select("id", V.zero_embedding(8).alias("embedding"))
    return V.search(zero, [0.0] * 8).agg(F.count(F.lit(1)).cast("int").alias("hits"))


@query("l5_vector_by_id", "SELECT vec_id AS id, embedding[1]::DOUBLE AS first FROM embeddings WHERE vec_id = 7")
def _(s, d):
    index = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return V.get(index, 7).select("id", F.get("embedding", 0).cast("double").alias("first"))


# Streams and layout in the rest


@query("n4_messages", "SELECT event_id, 'GitChanges' AS type, user_id::VARCHAR AS workspace FROM events")
def _(s, d):
    m = C.message("GitChanges", F.col("user_id").cast("string"), F.col("props"))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", m.alias("m")).select("event_id", "m.type", "m.workspace")


@query("n9_playback", table_sql([(k, int(k * 0.7 * 2) % 5) for k in range(12)], "k, frame"))
def _(s, d):
    return values(s, [(k, C.playback(list(range(5)), k * 0.7, 2.0)) for k in range(12)], "k int, frame int")


@query("n2_polls", table_sql([(0, 0), (1, 0), (2, 2), (3, 2)], "tick, value"))
def _(s, d):
    now = [0]
    p = C.Poller(lambda: now[0], 2.0, lambda: float(now[0]))
    rows = []
    for k in range(4):
        now[0] = k
        rows.append((k, p.poll()))
    return values(s, rows, "tick int, value int")


@query("n1_stream_of_changes", "SELECT user_id::VARCHAR AS key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at, event_type AS fingerprint FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def _(s, d):
    """The stream itself, over the events as files; one row a change."""
    stream = C.events_stream(s, d, s.read.parquet(f"{d}/events.parquet").schema, "events.parquet")
    keyed = stream.select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_type").alias("fingerprint"))
    return _streamed(s, C.only_changes(keyed)).select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "fingerprint")


CUSTOMER = 3_000_000_000

WATCHED = f"""WITH {fk_sql()}, c AS (SELECT {CUSTOMER} + user_id AS id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
n AS (SELECT id, count(*) AS n FROM c WHERE event_type IS DISTINCT FROM b GROUP BY id),
r AS (SELECT dst, src FROM edges WHERE relationship <> 'contains'),
one AS (SELECT DISTINCT src AS id FROM r WHERE dst IN (SELECT id FROM n JOIN nodes USING (id))), two AS (SELECT DISTINCT src AS id FROM r WHERE dst IN (SELECT id FROM one))"""


@query("n5_watch_loop", f"{WATCHED} SELECT 'changed' AS what, id, n FROM n UNION ALL SELECT 'impacted', id, min(k) FROM (SELECT id, 1 AS k FROM one UNION ALL SELECT id, 2 FROM two) WHERE id NOT IN (SELECT id FROM n JOIN nodes USING (id)) GROUP BY id")
def _(s, d):
    """Events as fingerprints of customers: the loop is stopped half way and started again from its checkpoint."""
    e, files = s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), shared(s, "arrived")
    loop, checkpoint = WatchLoop(fk_graph(s, d).cut(), shared(s, "watched")), shared(s, "cp")
    first, last = (F.unix_micros(x) for x in (F.min("ts"), F.max("ts")))
    low, high = e.agg(first, last).first()
    quarter = F.least(F.lit(3), F.floor((F.unix_micros("ts") - low) * 4 / max(1, high - low)).cast("int"))
    keyed = e.select((F.col("user_id") + CUSTOMER).cast("string").alias("key"), "ts", F.col("event_type").alias("fingerprint"), quarter.alias("quarter"))
    for half in ((0, 1), (2, 3)):
        for k in half:
            keyed.where(F.col("quarter") == k).drop("quarter").coalesce(1).write.parquet(f"{files}/{k}")
        stream = s.readStream.schema("key string, ts timestamp, fingerprint string").option("maxFilesPerTrigger", 1).parquet(f"{files}/*")
        running = loop.start(stream, checkpoint, availableNow=True)
        running.awaitTermination()
        running.stop()
    changed = loop.read("changes").groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("changed").alias("what"), "id", "n")
    mine = loop.graph.nodes.join(changed, "id", "left_semi").select("id")
    impacted = loop.read("impact").groupBy("id").agg(F.min("depth").cast("long").alias("n")).join(mine, "id", "left_anti")
    return changed.unionByName(impacted.select(F.lit("impacted").alias("what"), "id", "n"))


LIVES = """WITH e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS us FROM events), g AS (SELECT *, CASE WHEN us - lag(us) OVER w < 21600000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY key ORDER BY us)),
n AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY us ROWS UNBOUNDED PRECEDING) AS life FROM g), l AS (SELECT key, life, min(us) AS since, max(us) AS last, count(*) AS beats FROM n GROUP BY ALL),
o AS (SELECT *, lead(since) OVER (PARTITION BY key ORDER BY since) AS next FROM l)
SELECT key, since, last, last + 21600000000 AS until, beats FROM o WHERE next IS NOT NULL OR last + 21600000000 <= (SELECT max(us) // 1000 * 1000 - 3600000000 FROM e)"""


def _streamed(s, df):
    """What a finished stream gave, in files that the sink's own log names: no row of it is held by the driver."""
    at = shared(s, "given")
    df.writeStream.format("parquet").option("checkpointLocation", shared(s, "cp")).trigger(availableNow=True).start(at).awaitTermination()
    return s.read.schema(df.schema).parquet(at)


def _as_stream(s, d):
    return C.events_stream(s, d, s.read.parquet(f"{d}/events.parquet").schema, "events.parquet")


def _in_micros(df):
    return df.select("key", *[F.unix_micros(c).alias(c) for c in ("since", "last", "until")], "beats")


@query("n7_disconnects", LIVES)
def _(s, d):
    """Heartbeats as a stream: users silent for six hours, an hour of lateness."""
    beats = _as_stream(s, d).select(F.col("user_id").alias("key"), "ts")
    return _in_micros(_streamed(s, liveness.disconnects(beats, 6 * 3600, "1 hour")))


@query("n7_disconnects_of_a_table", LIVES)
def _(s, d):
    beats = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return _in_micros(liveness.disconnects_batch(beats, 6 * 3600, 3600))


@query("n8_registry", "SELECT user_id::VARCHAR AS key, event_id::VARCHAR AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type <> 'error' DESC, event_id::VARCHAR DESC) = 1 AND event_type <> 'error'")
def _(s, d):
    """Events as registrations, errors as unregistrations: who is registered in the end."""
    entries = _as_stream(s, d).select(F.col("user_id").alias("key"), "ts", F.col("event_id").cast("string").alias("value"), (F.col("event_type") != "error").alias("live"))
    return liveness.names(_streamed(s, liveness.registry(entries, 3600, "1 hour")))


@query("o8_iterations", table_sql([(10, 10), (1000, 5), (9000, 2)], "nodes, steps"))
def _(s, d):
    return values(s, [(n, L.iterations(n)) for n in (10, 1000, 9000)], "nodes int, steps int")


@query("j17_seed_patterns", f"WITH {ALIVE} SELECT id FROM s0 WHERE alive")
def _(s, d):
    return A.hot(living(s, d, torus(s, d)), 0.5).select("id")


@query("j13_damped_description", f"{SQL}{ROLES}{ticks_sql(DESCRIBED, [r for r in FULL if r == 'damped'], 2)} SELECT id, round(a, 6) AS activation FROM s2")
def _(s, d):
    g = fk_graph(s, d)
    run = A.with_description(g, P.describe(g), g.nodes.where(seeded_ids()))
    run.rules = A.Registry(A.DampedPropagation(0.5))
    return run.run_ticks(2).state.select("id", r6("activation"))


@query("e20_watch_scripts", table_sql([("a", "y")], "name, command"))
def _(s, d):
    return values(s, project.ProjectConfig("p", {"b": "x", "a": "y"}, ["a", "zz"]).watch_scripts(), "name string, command string")


@query("i13_added_edges", f"WITH {fk_sql()} SELECT count(*) + 1 AS n FROM edges")
def _(s, d):
    more = values(s, [(REGION, NATION, "uses", 9), (REGION, REGION, "uses", 9), (REGION, 77, "uses", 9)], "src long, dst long, relationship string, pos int")
    return fk_graph(s, d).add_edges(more).edges.agg(F.count(F.lit(1)).alias("n"))


@query("i14_node_metadata", f"{FK} SELECT id, CASE WHEN kind = 'Test' THEN 'true' END AS has_tests FROM nodes")
def _(s, d):
    g = fk_graph(s, d)
    g = api.Graph(g.nodes.withColumn("metadata", F.expr("cast(map() as map<string,string>)")), g.edges)
    out = g.with_metadata(g.nodes.where("kind = 'Test'").select("id", F.lit("true").alias("value")), "has_tests")
    return out.nodes.select("id", F.col("metadata")["has_tests"].alias("has_tests"))
