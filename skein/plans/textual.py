"""Scalars, text, logs, vectors, samplers and streams over the driver's tables and literal fixtures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import code, logs, scalars as S
from ..operators import automaton as A
from ..operators import joins as J
from ..operators import neighbours as N
from ..operators import vectors as V
from ..samplers import DegreeSampler, EmbeddingSampler, MetadataSampler, Pipeline
from ..sources import vcs
from ..streaming import changes as C
from .projections import doc_graph, doc_sql, fk_graph, fk_sql, twin
from .registry import query, r6
from .relational import CELLS, DEG, FK, torus

DOC = f"WITH {doc_sql()}"
#: A source file for each document, in one of four languages by its id, that refers to the files of later documents of its
#: language; one text for both engines.
SRC_TEXT = """
SELECT CAST(doc_id AS BIGINT) AS id, concat(source, CASE doc_id % 4 WHEN 3 THEN '/M' ELSE '/m' END, doc_id, CASE doc_id % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' WHEN 2 THEN '.ts' ELSE '.lean' END) AS path,
 CASE doc_id % 4
  WHEN 0 THEN concat('mod m', doc_id + 4, ';', chr(10), 'pub mod a ', chr(123), ' ', chr(125), chr(10), 'use crate::core::m', doc_id + 8, ';', chr(10), 'use std::', chr(123), 'fmt, io', chr(125), ';', chr(10), CASE WHEN doc_id % 8 = 0 THEN '#[test]' ELSE '// none' END, chr(10), '// ', n_chars)
  WHEN 1 THEN concat('import m', doc_id + 4, ', sys', chr(10), 'from .m', doc_id + 8, ' import User', chr(10), 'from . import x', chr(10), 'async def go', doc_id, '(a):', chr(10), '    await b', chr(10), 'class Big', doc_id, '(Base):', chr(10), '  def run(self): ', CASE WHEN doc_id % 8 = 1 THEN 'eval(1)' ELSE 'open(f)' END, chr(10), 'def test_it(): pass')
  WHEN 2 THEN concat('import x from "./m', doc_id + 4, '"', chr(10), 'import "../y"', chr(10), 'import z from "zod"', chr(10), 'describe(', n_chars, ')')
  ELSE concat('import Mathlib.M', doc_id, chr(10), 'public import Foo.M', doc_id + 4, chr(10), '-- import No', chr(10), 'open Topology Filter in', chr(10), 'open scoped Big', doc_id) END AS content
FROM {documents}
"""
#: A script's run for each event, its log of one of seven kinds by the event's id; rust, python and ts name files of SRC_TEXT.
LOG_TEXT = """
SELECT CAST(event_id AS BIGINT) AS pos, concat('run_', event_id) AS name, CAST(user_id AS BIGINT) AS user_id, CAST(CASE WHEN event_id % 7 = 6 THEN 0 ELSE event_id % 3 + 1 END AS INT) AS exit_code,
 CASE event_id % 7 WHEN 0 THEN concat('error[E0308]: mismatched m', 4 * (event_id % 50), chr(10), '  --> m', 4 * (event_id % 50), '.rs:', event_id % 1000, ':5', chr(10), 'warning: unused', chr(10), ' --> src/core.rs:3:1', chr(10))
  WHEN 2 THEN concat('Traceback', chr(10), '  File "m', 4 * (event_id % 50) + 1, '.py", line ', event_id % 1000, chr(10), 'ValueError') WHEN 3 THEN concat('cmd/f', user_id, '.go:', event_id % 1000, ':2: undefined: ', event_type) WHEN 5 THEN concat('step timed out after 5s', chr(10), 'more') ELSE '' END AS stderr,
 CASE event_id % 7 WHEN 1 THEN concat('src/a', user_id, '.c:7:3: error: expected ', event_type, chr(10), 'src/a', user_id, '.c:9:1: warning: unused variable') WHEN 4 THEN concat('m', 4 * (event_id % 50) + 2, '.ts(', event_id % 1000, ',9): error TS2304: Cannot find m', 4 * (event_id % 50) + 2) WHEN 6 THEN 'ok' ELSE '' END AS stdout,
 true AS ran
FROM {events}
"""


def sources(s, d):
    return s.sql(SRC_TEXT, documents=s.read.parquet(f"{d}/documents.parquet"))


def log_rows(s, d):
    return s.sql(LOG_TEXT, events=s.read.parquet(f"{d}/events.parquet"))


SRC_SQL = f"src AS MATERIALIZED ({twin(SRC_TEXT)})"
LOG_SQL = f"log AS MATERIALIZED ({twin(LOG_TEXT)})"
#: The files that the references of SRC_TEXT mean, where they exist.
MEANT = """meant AS (SELECT s.id AS source_id, s.kind, s.route, t.id AS target_id FROM (
  SELECT id, 'uses' AS kind, concat('m', id + 4, '.rs') AS route, id + 4 AS other FROM src WHERE id % 4 = 0 UNION ALL SELECT id, 'uses', concat('core/m', id + 8, '.rs'), id + 8 FROM src WHERE id % 4 = 0
  UNION ALL SELECT id, 'imports', concat('m', id + 4, '.py'), id + 4 FROM src WHERE id % 4 = 1 UNION ALL SELECT id, 'imports', concat('/m', id + 8, '.py'), id + 8 FROM src WHERE id % 4 = 1
  UNION ALL SELECT id, 'imports', concat('Foo/M', id + 4, '.lean'), id + 4 FROM src WHERE id % 4 = 3) s JOIN src t ON t.id = s.other)"""

# Paths and names


@query("c1_languages", f"{DOC} SELECT id, CASE regexp_extract(path, '\\.([^./]*)$', 1) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' WHEN 'md' THEN 'markdown' ELSE 'unknown' END AS language FROM nodes")
def _(s, d):
    return doc_graph(s, d).nodes.select("id", S.language("path").alias("language"))


@query("c2_node_kinds", f"{DOC} SELECT id, CASE WHEN NOT regexp_matches(path, '\\.(py|rs|ts)$') THEN 'File' WHEN contains(path, 'test') THEN 'Test' ELSE 'File' END AS kind FROM nodes")
def _(s, d):
    return doc_graph(s, d).nodes.select("id", S.node_kind("path", "name").alias("kind"))


@query("c3_directories", f"{DOC} SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS path, regexp_extract(regexp_extract(path, '^(.*)/[^/]*$', 1), '([^/]*)$', 1) AS name FROM nodes WHERE contains(path, '/')")
def _(s, d):
    p = doc_graph(s, d).nodes.select(J.parent_path("path").alias("path")).where("path is not null").distinct()
    return p.select("path", S.file_name("path").alias("name"))


@query("c10_source_files", f"{DOC} SELECT id, regexp_matches(path, '\\.(py|rs|ts)$') AS is_source FROM nodes")
def _(s, d):
    return doc_graph(s, d).nodes.select("id", S.is_source_file("path").alias("is_source"))


@query("c13_task_actions", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'AddTests' WHEN 1 THEN 'AddDocs' WHEN 2 THEN 'ReduceCoupling' WHEN 3 THEN 'GoalDirected' WHEN 4 THEN 'Fix' ELSE 'Refactor' END AS action FROM part")
def _(s, d):
    said = F.array(*[F.lit(x) for x in ("add unit tests", "document API", "extract interface", "ship it (goal-directed)", "fix: boom", "review cohesion")])
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", S.task_action(F.get(said, F.col("p_partkey") % 6)).alias("action"))


GOAL = "Implement the user-auth cache for API_v2, and fix login!"


@query("c14_goal_keywords", "SELECT unnest(['user-auth', 'cache', 'api_v2', 'login']) AS keyword")
def _(s, d):
    return s.range(1).select(F.explode(S.goal_keywords(F.lit(GOAL))).alias("keyword"))


@query("c15_goal_matches", f"{DOC} SELECT id FROM nodes WHERE contains(lower(path), 'parser') OR contains(lower(path), 'src3/')")
def _(s, d):
    n = doc_graph(s, d).nodes
    return n.where(S.matches_path(F.col("path"), F.array(F.lit("SRC3/")), S.goal_keywords(F.lit("improve the Parser")))).select("id")


@query("c16_shortened_paths", f"{DOC} SELECT id, CASE WHEN position('en/' IN path) > 0 THEN substr(path, position('en/' IN path) + 3) ELSE path END AS short FROM nodes")
def _(s, d):
    return doc_graph(s, d).nodes.select("id", S.shorten_path(F.col("path"), "en").alias("short"))


@query("c17_iso_times", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def _(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select("o_orderkey", S.epoch_to_iso(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("iso"))


@query("c18_relative_times", "SELECT event_id, CASE WHEN a < 60 THEN 'just now' WHEN a < 3600 THEN (a // 60) || 'm ago' WHEN a < 86400 THEN (a // 3600) || 'h ago' WHEN a < 604800 THEN (a // 86400) || 'd ago' WHEN a < 2592000 THEN (a // 604800) || 'w ago' ELSE (a // 2592000) || 'mo ago' END AS age FROM (SELECT event_id, event_id * 977 % 5000000 AS a FROM events)")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", S.relative_time(F.col("event_id") * 977 % 5000000).alias("age"))


@query("c19_change_labels", "SELECT event_type, count(*) AS n, CASE event_type WHEN 'click' THEN 'M' ELSE '?' END AS symbol FROM events GROUP BY event_type")
def _(s, d):
    kind = F.when(F.col("event_type") == "click", "Modified").otherwise("Untracked")
    return s.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", "n", S.lookup(S.CHANGE_LABELS, kind, "?").alias("symbol"))


@query("c20_kind_strings", f"{FK} SELECT id, lower(kind) AS kind FROM nodes")
def _(s, d):
    from ..operators.search import kind_string

    return fk_graph(s, d).nodes.select("id", kind_string(F.col("kind")).alias("kind"))


@query("c22_display_paths", f"{DOC} SELECT id, CASE WHEN starts_with(path, 'src0') THEN ltrim(substr(path, 5), '/') ELSE path END AS shown FROM nodes")
def _(s, d):
    return doc_graph(s, d).nodes.select("id", S.display_path(F.col("path"), "src0").alias("shown"))


@query("c24_entry_points", f"{FK} SELECT id, name = 'lib.rs' AS entry, contains(name, '_utils') AS utility FROM nodes")
def _(s, d):
    return fk_graph(s, d).nodes.select("id", S.is_entry_point("name").alias("entry"), S.is_utility("name").alias("utility"))


@query("c33_path_hints", f"{DOC} SELECT id, contains(path, 'parser') AS cpu, contains(path, 'api') AS io, contains(path, 'plugin') AS dyn FROM nodes")
def _(s, d):
    p = F.lower("path")
    return doc_graph(s, d).nodes.select("id", S.holds_any(p, S.CPU_HINTS).alias("cpu"), S.holds_any(p, S.IO_HINTS).alias("io"), S.holds_any(p, S.DYNAMIC_HINTS).alias("dyn"))


@query("c34_test_paths", f"{DOC} SELECT id, contains(path, '/test_') AS is_test FROM nodes")
def _(s, d):
    return doc_graph(s, d).nodes.select("id", S.is_test_path(F.col("path")).alias("is_test"))


@query("c35_slugs", f"{DOC} SELECT id, trim(regexp_replace(lower(path), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS ident FROM nodes")
def _(s, d):
    return doc_graph(s, d).nodes.select("id", S.slugify(F.col("path")).alias("slug"), S.identifier(F.col("name")).alias("ident"))


@query("c37_truncated_labels", "SELECT c_custkey, CASE WHEN length(c_name) > 12 THEN substr(c_name, 1, 9) || '...' ELSE c_name END AS label FROM customer")
def _(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", S.truncate_label(F.col("c_name"), 12).alias("label"))


@query("c39_scaled_sizes", f"{FK}{DEG}, m AS (SELECT min(in_degree) AS lo, max(in_degree) AS hi FROM deg) SELECT id, round(greatest(4.0, least(20.0, 4.0 + (in_degree - lo) / (hi - lo)::DOUBLE * 16.0)), 6) AS size FROM deg, m")
def _(s, d):
    from ..operators.degrees import degrees

    deg = degrees(fk_graph(s, d))
    m = F.broadcast(deg.agg(F.min("in_degree").alias("lo"), F.max("in_degree").alias("hi")))
    return deg.join(m).select("id", r6(S.scaled_size(F.col("in_degree"), F.col("lo"), F.col("hi")), "size"))


@query("c40_size_categories", "SELECT n AS nodes, CASE WHEN n < 1000 THEN 'Small' WHEN n < 3000 THEN 'Large' ELSE 'Huge' END AS category, CASE WHEN n < 1000 THEN 1 WHEN n < 3000 THEN 2 ELSE 4 END AS skip FROM (SELECT l_suppkey * 37 AS n FROM lineitem GROUP BY l_suppkey)")
def _(s, d):
    n = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") * 37).alias("nodes")).distinct()
    return n.select("nodes", S.size_category(F.col("nodes")).alias("category"), S.frame_skip(F.col("nodes")).alias("skip"))


@query("c41_pulse", f"SELECT event_id, round(1 + 0.3 * sin((value - floor(value)) * 2 * {math.pi}), 6) AS scale FROM events")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").select("event_id", r6(S.pulse(F.col("value")), "scale"))


@query("c42_merged_annotations", "SELECT c_custkey, 'own' AS a, c_mktsegment AS b, 'other' AS c FROM customer")
def _(s, d):
    m = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) and not x.startswith("c_") else F.col(x) for x in kv])
    merged = S.merge_annotations(m("a", "own", "b", "c_mktsegment"), m("a", "lost", "c", "other"))
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", merged["a"].alias("a"), merged["b"].alias("b"), merged["c"].alias("c"))


@query("c43_clamped", "SELECT c_custkey, greatest(0.0, least(1.0, c_acctbal / 5000)) AS activation FROM customer")
def _(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", A.clamp(F.col("c_acctbal") / 5000).alias("activation"))


@query("c50_fingerprint", "SELECT user_id, sha256(string_agg(DISTINCT event_type, chr(10) ORDER BY event_type)) AS fingerprint FROM events GROUP BY user_id")
def _(s, d):
    return s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(S.change_fingerprint("event_type").alias("fingerprint"))


@query("p94_display_labels", f"{FK} SELECT id, name AS label FROM nodes")
def _(s, d):
    return fk_graph(s, d).nodes.select("id", S.display_label(F.col("path"), F.lit(None).cast("string"), F.col("id")).alias("label"))


@query("f15_source_totals", "SELECT count(*) AS sources, sum(n_chars)::BIGINT AS size FROM documents")
def _(s, d):
    from ..sources.scan import totals

    return totals(s.read.parquet(f"{d}/documents.parquet").select(F.col("n_chars").alias("size")))


@query("f18_affected_roots", "SELECT n_regionkey AS id, greatest(1, count(DISTINCT n_nationkey % 3)) AS affected FROM nation GROUP BY n_regionkey")
def _(s, d):
    from ..operators.degrees import affected_roots

    return affected_roots(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_regionkey").alias("id"), F.concat(F.lit("crates/c"), F.col("n_nationkey") % 3, F.lit("/src/x.rs")).alias("path")))


@query("f9_change_summary", "SELECT count(*) FILTER (event_type = 'click') AS modified, count(*) FILTER (event_type = 'view') AS added, 0::BIGINT AS deleted, count(*) FILTER (event_type NOT IN ('click', 'view')) AS untracked FROM events")
def _(s, d):
    kind = F.when(F.col("event_type") == "click", "Modified").when(F.col("event_type") == "view", "Added").otherwise("Untracked")
    return vcs.summary(s.read.parquet(f"{d}/events.parquet").select(kind.alias("kind")))


# Source text


@query("c4_rust_references", f"WITH {SRC_SQL} SELECT id AS source_id, 'uses' AS kind, concat('m', id + 4, '.rs') AS route FROM src WHERE id % 4 = 0 UNION ALL SELECT id AS source_id, 'uses' AS kind, concat('m', id + 4, '/mod.rs') AS route FROM src WHERE id % 4 = 0 UNION ALL SELECT id AS source_id, 'uses' AS kind, concat('core/m', id + 8, '.rs') AS route FROM src WHERE id % 4 = 0 UNION ALL SELECT id AS source_id, 'uses' AS kind, 'std.rs' AS route FROM src WHERE id % 4 = 0")
def _(s, d):
    return code.reference_rows(sources(s, d).where("id % 4 = 0"))


@query("c5_python_references", f"WITH {SRC_SQL} SELECT id AS source_id, 'imports' AS kind, concat('m', id + 4, '.py') AS route FROM src WHERE id % 4 = 1 UNION ALL SELECT id AS source_id, 'imports' AS kind, concat('/m', id + 8, '.py') AS route FROM src WHERE id % 4 = 1")
def _(s, d):
    return code.reference_rows(sources(s, d).where("id % 4 = 1"))


@query("c6_ts_references", f"WITH {SRC_SQL} SELECT id AS source_id, 'imports' AS kind, concat('./m', id + 4) AS route FROM src WHERE id % 4 = 2 UNION ALL SELECT id AS source_id, 'imports' AS kind, '../y' AS route FROM src WHERE id % 4 = 2")
def _(s, d):
    return code.reference_rows(sources(s, d).where("id % 4 = 2"))


@query("c7_lean_references", f"WITH {SRC_SQL} SELECT id AS source_id, 'imports' AS kind, concat('Mathlib/M', id, '.lean') AS route FROM src WHERE id % 4 = 3 UNION ALL SELECT id AS source_id, 'imports' AS kind, concat('Foo/M', id + 4, '.lean') AS route FROM src WHERE id % 4 = 3 UNION ALL SELECT id AS source_id, 'uses' AS kind, 'Topology.lean' AS route FROM src WHERE id % 4 = 3 UNION ALL SELECT id AS source_id, 'uses' AS kind, 'Filter.lean' AS route FROM src WHERE id % 4 = 3 UNION ALL SELECT id AS source_id, 'uses' AS kind, concat('Big', id, '.lean') AS route FROM src WHERE id % 4 = 3")
def _(s, d):
    return code.reference_rows(sources(s, d).where("id % 4 = 3"))


@query("c9_inline_tests", f"WITH {SRC_SQL} SELECT id, CASE WHEN path LIKE '%.rs' THEN contains(content, '#[test]') OR contains(content, '#[cfg(test)]') WHEN path LIKE '%.py' THEN contains(content, 'def test_') OR contains(content, 'class Test') WHEN path LIKE '%.ts' THEN contains(content, 'describe(') ELSE false END AS has_tests FROM src")
def _(s, d):
    return sources(s, d).select("id", S.has_inline_tests(F.col("content"), F.col("path")).alias("has_tests"))


@query("c31_python_contract", f"WITH {SRC_SQL}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM src WHERE path LIKE '%.py'), k AS (SELECT id, line, trim(raw) AS x FROM l) SELECT id, line::INT AS line, CASE WHEN starts_with(x, 'async def ') THEN 'async' WHEN starts_with(x, 'def ') THEN 'function' WHEN starts_with(x, 'class ') THEN 'class' ELSE 'import' END AS kind, CASE WHEN regexp_matches(x, '^(import|from) ') THEN x ELSE trim(regexp_extract(x, '^(?:async def|def|class) ([^(:]*)', 1)) END AS name FROM k WHERE regexp_matches(x, '^(async def|def|class|import|from) ')")
def _(s, d):
    return code.python_contract(sources(s, d).where("path like '%.py'"))


@query("c32_risk_signals", f"WITH {SRC_SQL} SELECT id, 'async' AS category FROM src WHERE contains(lower(content), 'await ') OR contains(lower(content), 'async def ') UNION ALL SELECT id, 'io' FROM src WHERE contains(lower(content), 'open(') UNION ALL SELECT id, 'dynamic_python' FROM src WHERE contains(lower(content), 'eval(')")
def _(s, d):
    return code.risk_signals(sources(s, d)).select("id", "category")


TEXTS = {"python": ("import a", "x = 1", "# note", "def f(): pass"), "rust": ("use a;", "let x;", "/// doc", "pub fn f() {}"), "typescript": ("import a", "let x", "// c", "export function f() {}")}


@query("c27_excerpts", f"SELECT doc_id, replace(CASE doc_id % 4 {' '.join(f"WHEN {k} THEN '{'|'.join(t[:1] + t[2:])}'" for k, t in enumerate(TEXTS.values()))} END, '|', chr(10)) || chr(10) || CASE doc_id % 4 WHEN 1 THEN 'use ' ELSE 'import ' END || doc_id AS excerpt FROM documents WHERE doc_id % 4 < 2 UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN replace('import a|// c|export function f() {{}}', '|', chr(10)) || chr(10) || 'import ' || doc_id END FROM documents WHERE doc_id % 4 >= 2")
def _(s, d):
    """Four lines of each language, of which one is none of those that count, and an import; a language without marks has none."""
    docs, k = s.read.parquet(f"{d}/documents.parquet").select("doc_id"), F.col("doc_id") % 4
    content, language = F.lit("plain"), F.lit("markdown")
    for i, (name, lines) in enumerate(TEXTS.items()):
        content = F.when(k == i, F.concat(F.lit("\n".join(lines) + ("\nuse " if name == "rust" else "\nimport ")), "doc_id")).otherwise(content)
        language = F.when(k == i, F.lit(name)).otherwise(language)
    return docs.select("doc_id", code.excerpt(content, language).alias("excerpt"))


@query("e6_resolved_routes", f"WITH {SRC_SQL}, {MEANT} SELECT source_id, route, target_id FROM meant")
def _(s, d):
    src = sources(s, d)
    return J.resolve_routes(code.reference_rows(src), src.select("id", F.col("id").alias("pos"), "path")).select("source_id", "route", "target_id")


@query("i1_source_graph", f"WITH {SRC_SQL}, {MEANT} SELECT split_part(path, '/', 1) AS from_path, path AS to_path, 'contains' AS relationship FROM src UNION ALL SELECT DISTINCT a.path, b.path, kind FROM meant JOIN src a ON a.id = source_id JOIN src b ON b.id = target_id")
def _(s, d):
    from ..sources.scan import build_graph

    g = build_graph(sources(s, d).select(F.col("path").alias("relative_path"), S.file_name("path").alias("name"), "content"))
    named = g.nodes.select("id", "path")
    return g.edges.join(named.withColumnsRenamed({"id": "src", "path": "from_path"}), "src").join(named.withColumnsRenamed({"id": "dst", "path": "to_path"}), "dst").select("from_path", "to_path", "relationship")


LINKS = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages"


@query("c6_page_links", f"SELECT page_id, target, count(*) AS n FROM ({LINKS}) GROUP BY page_id, target")
def _(s, d):
    p = s.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


# Logs

ERR_SQL = f"""WITH {LOG_SQL}, t AS (SELECT name, coalesce(stderr, '') || chr(10) || coalesce(stdout, '') AS x FROM log),
m AS (SELECT name, 0 AS p, unnest(regexp_extract_all(x, '(error|warning)(?:\\[E\\d+\\])?: (.+)\\n\\s*--> (.+):(\\d+):\\d+', 3)) AS file, unnest(regexp_extract_all(x, '(error|warning)(?:\\[E\\d+\\])?: (.+)\\n\\s*--> (.+):(\\d+):\\d+', 4)) AS line, unnest(regexp_extract_all(x, '(error|warning)(?:\\[E\\d+\\])?: (.+)\\n\\s*--> (.+):(\\d+):\\d+', 2)) AS message, unnest(regexp_extract_all(x, '(error|warning)(?:\\[E\\d+\\])?: (.+)\\n\\s*--> (.+):(\\d+):\\d+', 1)) AS sev FROM t
UNION ALL SELECT name, 1, unnest(regexp_extract_all(x, '([^\\s:]+):(\\d+):\\d+: (error|warning): (.+)', 1)), unnest(regexp_extract_all(x, '([^\\s:]+):(\\d+):\\d+: (error|warning): (.+)', 2)), unnest(regexp_extract_all(x, '([^\\s:]+):(\\d+):\\d+: (error|warning): (.+)', 4)), unnest(regexp_extract_all(x, '([^\\s:]+):(\\d+):\\d+: (error|warning): (.+)', 3)) FROM t
UNION ALL SELECT name, 2, unnest(regexp_extract_all(x, 'File "(.+)", line (\\d+)', 1)), unnest(regexp_extract_all(x, 'File "(.+)", line (\\d+)', 2)), 'Python error', 'error' FROM t
UNION ALL SELECT name, 3, unnest(regexp_extract_all(x, '([^\\s]+\\.go):(\\d+):\\d+: (.+)', 1)), unnest(regexp_extract_all(x, '([^\\s]+\\.go):(\\d+):\\d+: (.+)', 2)), unnest(regexp_extract_all(x, '([^\\s]+\\.go):(\\d+):\\d+: (.+)', 3)), 'error' FROM t
UNION ALL SELECT name, 4, unnest(regexp_extract_all(x, '(.+)\\((\\d+),\\d+\\): error TS\\d+: (.+)', 1)), unnest(regexp_extract_all(x, '(.+)\\((\\d+),\\d+\\): error TS\\d+: (.+)', 2)), unnest(regexp_extract_all(x, '(.+)\\((\\d+),\\d+\\): error TS\\d+: (.+)', 3)), 'error' FROM t),
err AS (SELECT name AS script, file, line::INT AS line, trim(message) AS message, CASE WHEN arg_min(sev, p) = 'warning' THEN 'Warning' ELSE 'Error' END AS severity FROM m GROUP BY ALL)"""
ERR_SQL = ERR_SQL.replace("GROUP BY ALL", "GROUP BY name, file, line, trim(message)")


@query("k24_parsed_errors", f"{ERR_SQL} SELECT script, file, line, message, severity FROM err")
def _(s, d):
    return logs.parse_errors(log_rows(s, d)).drop("pos")


for _k, _name in enumerate(("rust", "generic", "python", "go", "typescript")):

    def _one(s, d, k=_k):
        t = F.concat_ws("\n", "stderr", "stdout")
        return log_rows(s, d).select("name", F.explode(logs.errors_of(t, k)).alias("e")).select("name", "e.file", "e.line", "e.message", "e.severity")

    query(f"p{_k + 1}_{_name}_errors", f"{ERR_SQL} SELECT name, file, line::INT AS line, trim(message) AS message, CASE WHEN sev = 'warning' THEN 'Warning' ELSE 'Error' END AS severity FROM m WHERE p = {_k}")(_one)


@query("k26_failures", f"{ERR_SQL} SELECT script, file, line, message, severity FROM err UNION ALL SELECT name, '<script:' || name || '>', 0, 'step timed out after 5s', 'Error' FROM log WHERE exit_code <> 0 AND name NOT IN (SELECT script FROM err)")
def _(s, d):
    return logs.with_failures(log_rows(s, d), logs.parse_errors(log_rows(s, d))).drop("pos")


@query("f20_feedback", f"{ERR_SQL} SELECT count(*) FILTER (exit_code = 0) AS passed, count(*) FILTER (exit_code <> 0) AS failed, (SELECT count(*) FROM err) AS errors FROM log")
def _(s, d):
    return logs.feedback(log_rows(s, d), logs.parse_errors(log_rows(s, d)))


@query("f21_errored_files", f"{ERR_SQL} SELECT DISTINCT file FROM err")
def _(s, d):
    return logs.errored_files(logs.parse_errors(log_rows(s, d)))


@query("f22_summary_line", f"{ERR_SQL} SELECT user_id, string_agg(x, ' | ' ORDER BY pos) AS summary FROM (SELECT user_id, pos, name || ': ' || CASE WHEN exit_code = 0 THEN 'ok' ELSE coalesce(n, 0) || ' errors' END AS x FROM log LEFT JOIN (SELECT script, count(*) AS n FROM err GROUP BY script) e ON script = name) GROUP BY user_id")
def _(s, d):
    """A line for each user's runs."""
    return logs.summary_line(log_rows(s, d), logs.parse_errors(log_rows(s, d)), "user_id")


@query("p6_script_outcomes", f"WITH {LOG_SQL} SELECT name, exit_code = 0 AS success, exit_code <> 0 AS crashed FROM log")
def _(s, d):
    return log_rows(s, d).select("name", logs.success(F.col("exit_code")).alias("success"), logs.crashed(F.col("exit_code")).alias("crashed"))


@query("c45_diagnostic_lines", f"WITH {LOG_SQL} SELECT name, CASE WHEN stderr <> '' THEN CASE WHEN contains(stderr, 'timed out') THEN 'step timed out after 5s' ELSE string_split(stderr, chr(10))[1] END END AS line FROM log")
def _(s, d):
    return log_rows(s, d).select("name", S.diagnostic_line(F.col("stderr")).alias("line"))


@query("c46_scrubbed_responses", "SELECT doc_id, concat('{\"a\": ', n_chars, '}') AS answer FROM documents")
def _(s, d):
    """Answers between fences of a language, bare, and between plain fences, by the document's id."""
    k, bare = F.col("doc_id") % 3, F.concat(F.lit('{"a": '), "n_chars", F.lit("}"))
    fenced = F.when(k == 0, F.concat(F.lit("```json\n"), bare, F.lit("\n```"))).when(k == 1, bare).otherwise(F.concat(F.lit("```\n"), bare, F.lit("\n```")))
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", S.scrub_response(fenced).alias("answer"))


@query("d16_first_errors", f"""WITH {SRC_SQL}, e AS (SELECT DISTINCT 4 * (event_id % 50) AS k, event_id % 7 AS log FROM events)
SELECT id, CASE log WHEN 2 THEN 'Python error' WHEN 0 THEN concat('mismatched m', id) ELSE concat('Cannot find m', id) END AS error FROM src JOIN e ON (log = 0 AND id = k) OR (log = 2 AND id = k + 1) OR (log = 4 AND id = k + 2)""")
def _(s, d):
    from ..operators.planning import first_errors

    return first_errors(sources(s, d).select("id", "path"), logs.parse_errors(log_rows(s, d)))


# Vectors

QV = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
COS = f"s AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, {QV} x)"


def _index(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


def _query(s, d):
    return [float(x) for x in _index(s, d).where("id = 0").first()["embedding"]]


@query("l3_vector_search", f"WITH {COS} SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 10")
def _(s, d):
    return V.search(_index(s, d), _query(s, d)).select("id", r6("score"))


@query("l4_vector_search_above", f"WITH {COS} SELECT id, round(score, 6) AS score FROM s WHERE s.score >= 0.2 ORDER BY s.score DESC, id LIMIT 25")
def _(s, d):
    return V.search(_index(s, d), _query(s, d), 25, 0.2).select("id", r6("score"))


@query("l7_goal_scores", f"WITH {COS} SELECT id, round(score, 6) AS score FROM s")
def _(s, d):
    return V.scores(_index(s, d), _query(s, d)).select("id", r6("score"))


@query("l8_semantic_neighbors", f"WITH {COS} SELECT id, round(score, 6) AS score, printf('semantic(%.2f)', score) AS label FROM s WHERE id <> 0 AND s.score > 0.1 ORDER BY s.score DESC, id LIMIT 5")
def _(s, d):
    return V.neighbors_of(_index(s, d), 0).select("id", r6("score"), "label")


NEAR = """WITH u AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT a.id, b.id AS peer, list_cosine_similarity(a.e, b.e) AS score FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 12) DESC, peer) AS n FROM s WHERE score > 0.1)"""


@query("l8_neighbors_of_all", f"{NEAR} SELECT id, peer, round(score, 6) AS score, printf('semantic(%.2f)', score) AS label FROM r WHERE n <= 5")
def _(s, d):
    return N.all_neighbours(_index(s, d)).select("id", "peer", r6("score"), "label")


@query("c44_norms", "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def _(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", r6(S.l2_norm(F.col("embedding")), "norm"))


@query("l1_upsert", "SELECT vec_id AS id, CASE WHEN vec_id < 5 THEN 0.0 ELSE embedding[1]::DOUBLE END AS x FROM embeddings UNION ALL SELECT -1, 0.0")
def _(s, d):
    new = s.range(-1, 5).select("id", F.array_repeat(F.lit(0.0).cast("float"), 64).alias("embedding"))
    return V.upsert(_index(s, d), new).select("id", F.get("embedding", 0).cast("double").alias("x"))


LOGGED = """WITH changes AS (
  SELECT vec_id AS id, 1 AS v, 0 AS seq, false AS gone, embedding[1]::DOUBLE AS x FROM embeddings
  UNION ALL SELECT vec_id, 2, k, false, embedding[1 + k]::DOUBLE FROM embeddings, range(4) r(k) WHERE vec_id % 3 = 0
  UNION ALL SELECT vec_id, 3, 0, true, NULL FROM embeddings WHERE vec_id % 5 = 0
  UNION ALL SELECT -1 - vec_id, 4, 0, false, embedding[2]::DOUBLE FROM embeddings
  UNION ALL SELECT vec_id, 5, 0, false, embedding[9]::DOUBLE FROM embeddings WHERE vec_id % 10 = 0)
SELECT id, arg_max(x, (v, seq)) AS x FROM (SELECT *, arg_max(gone, (v, seq)) OVER (PARTITION BY id) AS last_gone FROM changes) WHERE NOT last_gone AND NOT gone GROUP BY id"""


@query("l1_logged_upserts", LOGGED)
def _(s, d):
    """Every vector, then new versions of some in order, removals, more vectors, a compaction, and removed ones again."""
    from ..sources.vector_log import VectorLog
    from .surface import shared

    log, index = VectorLog(s, shared(s, "vectors")), _index(s, d)
    only = lambda at: F.array(F.get("embedding", at))
    log.upsert(index.select("id", only(F.lit(0)).alias("embedding")))
    versions = index.where("id % 3 = 0").withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3))))
    log.upsert(versions.select("id", "seq", only(F.col("seq")).alias("embedding")))
    log.remove(index.where("id % 5 = 0"))
    log.upsert(index.select((-1 - F.col("id")).alias("id"), only(F.lit(1)).alias("embedding")))
    log.compact()
    log.upsert(index.where("id % 10 = 0").select("id", only(F.lit(8)).alias("embedding")))
    return log.read().select("id", F.get("embedding", 0).cast("double").alias("x"))


@query("l2_remove", "SELECT vec_id AS id FROM embeddings WHERE vec_id <> 3")
def _(s, d):
    return V.remove(_index(s, d), 3).select("id")


@query("l9_embedded_nodes", f"{DOC}, w AS (SELECT id, unnest(regexp_extract_all(lower(kind || ' ' || path), '[\\p{{L}}\\p{{N}}]+')) AS w FROM nodes WHERE kind IN ('File', 'Module')), p AS (SELECT id, ('0x' || md5(w)[1:7])::BIGINT % 64 AS place, sum(CASE WHEN ('0x' || md5(w)[8:14])::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS x FROM w GROUP BY ALL) SELECT id, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 5) AS x FROM p WHERE x <> 0")
def _(s, d):
    own = EmbeddingSampler().vectors(EmbeddingSampler().selector().matches(doc_graph(s, d).nodes))
    return own.select("id", F.posexplode("embedding").alias("place", "x")).where("x <> 0").select("id", F.col("place").cast("long").alias("place"), F.round(F.col("x").cast("double"), 5).alias("x"))


# Samplers


@query("m2_sampler_pipeline", f"{FK}{DEG} SELECT n.id, CASE WHEN kind = 'File' THEN '{{\"in\":' || in_degree || ',\"out\":' || out_degree || ',\"total\":' || (in_degree + out_degree) || '}}' END AS degree, CASE WHEN kind IN ('File', 'Module') THEN '{{\"model\":\"feature-hash\",\"dim\":64}}' END AS embedding FROM nodes n JOIN deg USING (id)")
def _(s, d):
    notes = Pipeline(DegreeSampler()).with_stage(EmbeddingSampler()).run(fk_graph(s, d))
    return notes.select("id", F.col("annotations")["degree"].alias("degree"), F.col("annotations")["embedding"].alias("embedding"))


@query("m5_metadata_sampler", f"WITH {CELLS} SELECT id, '{{\"x\":\"' || x || '\"}}' AS artifact FROM cells")
def _(s, d):
    return MetadataSampler(["x"]).sample(torus(s, d)).artifacts


# Events as histories and streams

EV = "WITH h AS (SELECT user_id AS id, event_id AS seq, least(1.0, value / 100.0) AS activation, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)"


def _history(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.least(F.lit(1.0), F.col("value") / 100.0).alias("activation"))


@query("g10_last_transitions", f"{EV} SELECT id, seq FROM h WHERE n <= 4")
def _(s, d):
    return A.last_transitions(_history(s, d), 4).select("id", "seq")


@query("f24_activation_trend", f"{EV} SELECT id, round(avg(activation), 6) AS avg, round(min(activation), 6) AS min, round(max(activation), 6) AS max FROM h WHERE n <= 4 GROUP BY id")
def _(s, d):
    return A.activation_trend(_history(s, d), 3).select("id", r6("avg"), r6("min"), r6("max"))


TICKS = "t AS (SELECT row_number() OVER (ORDER BY date_trunc('day', ts)) AS tick, count(*) FILTER (event_type = 'click') AS transitions, count(*) FILTER (event_type <> 'click') AS skipped, avg(value) / 1000 AS avg_activation FROM events GROUP BY date_trunc('day', ts))"


@query("g13_stability_marks", f"WITH {TICKS}, r AS (SELECT *, transitions / (transitions + skipped)::DOUBLE AS rate FROM t) SELECT tick, round(rate, 6) AS rate, count(*) OVER a = 3 AND max(rate) OVER a < 0.01 AS quiet, count(*) OVER b = 5 AND var_pop(avg_activation) OVER b < 0.001 AS converged FROM r WINDOW a AS (ORDER BY tick ROWS 2 PRECEDING), b AS (ORDER BY tick ROWS 4 PRECEDING)")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("transitions"), F.count_if(F.col("event_type") != "click").alias("skipped"), (F.avg("value") / 1000).alias("avg_activation"))
    return A.stability_marks(J.ranked(e, F.asc("day"), name="tick").withColumn("tick", F.col("tick").cast("long"))).select("tick", r6("rate"), "quiet", "converged")


@query("f25_percentiles", "WITH w AS (SELECT event_id AS pos, value AS ms FROM events ORDER BY event_id DESC LIMIT 120), a AS (SELECT list(ms ORDER BY ms) AS v, avg(ms) AS m FROM w) SELECT round(1000 / m, 6) AS avg_fps, v[61] AS p50, v[115] AS p95, v[119] AS p99, v[120] AS max FROM a")
def _(s, d):
    return C.percentiles(s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("pos"), F.col("value").alias("ms"))).select(r6("avg_fps"), "p50", "p95", "p99", "max")


@query("n1_only_changes", "SELECT user_id::VARCHAR AS key, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type IS DISTINCT FROM b")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.struct("ts", "event_id").alias("ts"), F.col("event_type").alias("fingerprint"))
    return C.only_changes_batch(e).select("key", F.col("ts.event_id").alias("event_id"))


@query("n7_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM n GROUP BY user_id, k")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return C.sessions(e, "30 minutes").select("user_id", "events", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("x1_windowed_events", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return C.windowed(e).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("n11_restart_policies", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN event_id % 3 = 0 WHEN 2 THEN event_id % 5 <> 0 ELSE true END AS restart FROM events")
def _(s, d):
    policy = F.get(F.array(*[F.lit(x) for x in ("never", "on_code_change", "on_crash", "always")]), F.col("event_id") % 4)
    return s.read.parquet(f"{d}/events.parquet").select("event_id", C.should_restart(policy, F.col("event_id") % 3 == 0, (F.col("event_id") % 5).cast("int")).alias("restart"))


@query("f12_temporal_stats", f"WITH {fk_sql()}, q AS (SELECT id, id % 3 AS k FROM nodes) SELECT count(*) AS nodes, sum(k + 1)::BIGINT AS transitions, 0.25::DOUBLE AS avg_activation, count(*) FILTER (k > 0) AS evolved, (SELECT count(*) FROM edges) AS edges FROM q")
def _(s, d):
    g = fk_graph(s, d)
    done = g.nodes.where("id % 3 > 0").select("id", F.explode(F.sequence(F.lit(1), (F.col("id") % 3).cast("int"))).alias("seq"))
    return A.temporal_stats(g, g.nodes.select("id", F.lit(0.25).alias("activation")), done)
