"""References, contracts, risks and logs of small texts whose odd lines the tables' files don't have."""

import pytest
from pyspark.sql import functions as F

from skein.functions import code, logs
from skein.functions import scalars as S
from skein.operators import joins as J
from skein.operators.planning import first_errors
from skein.sources.scan import build_graph

SOURCES = [
    (1, "src/lib.rs", "mod parser;\npub mod a { }\npub mod util;\nuse crate::core::Graph;\nuse std::{fmt, io};\n  use self::x::y;\n#[test]\nfn t() {}"),
    (2, "src/app.py", "import os.path, sys\nfrom .models import User\nfrom . import x\nfrom ..up import y\nimport numpy as np\nasync def go(a):\n    await b\nclass Big(Base):\n  def run(self): eval('1')\ndef test_it(): pass"),
    (3, "web/index.ts", "import x from './x'\nimport \"../y\"\nimport z from 'zod'\nconst a = 1\ndescribe('a')"),
    (4, "Proof.lean", "import Mathlib.Topology.Basic\npublic import Foo.Bar\n-- import No\nopen Topology Filter in\nopen scoped BigOperators"),
    (5, "src/parser.rs", "use crate::lib;\nuse super::core;"),
    (6, "src/core.rs", "// nothing"),
    (7, "src/models.py", "x = open('f')"),
]
LOGS = [
    (0, "check", 101, "error[E0308]: mismatched types\n  --> src/lib.rs:10:5\nwarning: unused\n --> src/core.rs:3:1\n", ""),
    (1, "cc", 1, "", "src/a.c:7:3: error: expected ';'\nsrc/a.c:9:1: warning: unused variable"),
    (2, "pytest", 1, 'Traceback\n  File "src/app.py", line 12\nValueError', ""),
    (3, "go", 2, "cmd/main.go:5:2: undefined: x", ""),
    (4, "tsc", 2, "", "web/index.ts(4,9): error TS2304: Cannot find name 'q'."),
    (5, "lint", 3, "step timed out after 5s\nmore", ""),
    (6, "fmt", 0, "", "ok"),
]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SOURCES, "id long, path string, content string")


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(LOGS, "pos int, name string, exit_code int, stderr string, stdout string")


def test_references(sources):
    got = {}
    for r in code.reference_rows(sources).collect():
        got.setdefault(r.source_id, []).append((r.kind, r.route))
    assert sorted(got[1]) == sorted(("uses", x) for x in ("parser.rs", "parser/mod.rs", "util.rs", "util/mod.rs", "core/Graph.rs", "std.rs", "x/y.rs"))
    assert got[2] == [("imports", "os/path.py"), ("imports", "/models.py"), ("imports", "numpy.py")] and got[3] == [("imports", "./x"), ("imports", "../y")]
    assert got[4] == [("imports", "Mathlib/Topology/Basic.lean"), ("imports", "Foo/Bar.lean"), ("uses", "Topology.lean"), ("uses", "Filter.lean"), ("uses", "BigOperators.lean")]
    resolved = J.resolve_routes(code.reference_rows(sources), sources.select("id", F.col("id").alias("pos"), "path"))
    assert sorted((r.source_id, r.route, r.target_id) for r in resolved.collect()) == [(1, "parser.rs", 5), (2, "/models.py", 7), (5, "core.rs", 6), (5, "lib.rs", 1)]


def test_the_graph_of_the_sources(sources):
    g = build_graph(sources.select(F.col("path").alias("relative_path"), S.file_name("path").alias("name"), "content"))
    path = {r.id: r.path for r in g.nodes.collect()}
    assert sorted((path[r.src], path[r.dst]) for r in g.edges.where("relationship <> 'contains'").collect()) == [("src/app.py", "src/models.py"), ("src/lib.rs", "src/parser.rs"), ("src/parser.rs", "src/core.rs"), ("src/parser.rs", "src/lib.rs")]


def test_contracts_and_risks(sources):
    rows = {(r.line, r.kind, r.name) for r in code.python_contract(sources.where("id = 2")).collect()}
    assert {(6, "async", "go"), (8, "class", "Big"), (9, "function", "run"), (10, "function", "test_it"), (1, "import", "import os.path, sys")} <= rows and len(rows) == 9
    assert sorted((r.id, r.category) for r in code.risk_signals(sources).collect()) == [(2, "async"), (2, "dynamic_python"), (7, "io")]


def test_logs(runs, sources):
    errors = logs.parse_errors(runs)
    assert sorted((r.script, r.file, r.line, r.severity) for r in errors.collect()) == [("cc", "src/a.c", 7, "Error"), ("cc", "src/a.c", 9, "Warning"), ("check", "src/core.rs", 3, "Warning"), ("check", "src/lib.rs", 10, "Error"), ("go", "cmd/main.go", 5, "Error"), ("pytest", "src/app.py", 12, "Error"), ("tsc", "web/index.ts", 4, "Error")]
    assert logs.summary_line(runs, errors).first()[0] == "check: 2 errors | cc: 2 errors | pytest: 1 errors | go: 1 errors | tsc: 1 errors | lint: 0 errors | fmt: ok"
    assert [r.file for r in logs.with_failures(runs, errors).where("line = 0").collect()] == ["<script:lint>"]
    assert {r.id: r.error for r in first_errors(sources.select("id", "path"), errors).collect()} == {1: "mismatched types", 6: "unused", 2: "Python error", 3: "Cannot find name 'q'."}
