"""Running a project's scripts on the driver, and their output as a table of logs."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph

LOGS = "pos int, name string, exit_code int, stdout string, stderr string"


def run_script(name: str, command: str, folder: str, timeout: float | None = None) -> tuple[str, int, str, str]:
    """name, exit code (-1: timed out), output and errors."""
    try:
        r = subprocess.run(["sh", "-c", command], cwd=folder, capture_output=True, text=True, timeout=timeout)
        return name, r.returncode, r.stdout, r.stderr
    except subprocess.TimeoutExpired as e:
        text = lambda b: b.decode("utf-8", "replace") if isinstance(b, bytes) else b or ""
        return name, -1, text(e.stdout), f"timed out after {timeout:g}s\n{text(e.stderr)}"


def run_scripts(spark: SparkSession, scripts: Iterable[tuple[str, str]], folder: str, timeout: float | None = None) -> DataFrame:
    """In order, one after the other; see LOGS."""
    return spark.createDataFrame([(k, *run_script(n, c, folder, timeout)) for k, (n, c) in enumerate(scripts)], LOGS)


def materialise(g: Graph, folder: str) -> int:
    """Makes the folders and empty files of a graph that don't exist yet, below ``folder``; how many. Rows stream to the driver."""
    made = 0
    for r in g.nodes.select("path", "kind").toLocalIterator():
        full = os.path.realpath(os.path.join(folder, r["path"]))
        if os.path.commonpath([full, os.path.realpath(folder)]) != os.path.realpath(folder) or os.path.exists(full):
            continue
        if r["kind"] == "Directory":
            os.makedirs(full)
        else:
            os.makedirs(os.path.dirname(full), exist_ok=True)
            open(full, "w").close()
        made += 1
    return made


def test_scaffold(module: str, functions: Iterable[str]) -> str:
    """Text of a test file with one empty test for each function."""
    return f"import {module}\n" + "".join(f"\n\ndef test_{f}():\n    assert callable({module}.{f})\n" for f in functions)
