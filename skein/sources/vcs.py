"""Version control as tables: status, log, branches and diffs of local repositories, by their command-line tool, read only."""

from __future__ import annotations

import os
import subprocess
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "path string, kind string, staged boolean"
#: Porcelain letters.
KINDS = {"M": "Modified", "T": "Modified", "A": "Added", "D": "Deleted", "R": "RenamedTo", "C": "Added"}


def _git(repo: str, *args: str) -> str:
    out = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True)
    return out.stdout if out.returncode == 0 else ""


def status_rows(porcelain: str) -> list[tuple[str, str, bool]]:
    """Up to two rows for each path of ``status --porcelain -z``: index, then work tree."""
    out, parts, k = [], porcelain.split("\0"), 0
    while k < len(parts):
        entry = parts[k]
        k += 1
        if len(entry) < 4:
            continue
        x, y, path = entry[0], entry[1], entry[3:]
        k += x in "RC"  # the old name follows
        if x == "?":
            out.append((path, "Untracked", False))
            continue
        if x in KINDS:
            out.append((path, KINDS[x], True))
        if y in KINDS:
            out.append((path, KINDS[y], False))
    return out


def changes(spark: SparkSession, repo: str, absolute: bool = False) -> DataFrame:
    """path, kind, staged, captured_at; none for what is no repository."""
    rows = status_rows(_git(repo, "status", "--porcelain", "-z", "--untracked-files=all"))
    if absolute:
        rows = [(os.path.join(os.path.abspath(repo), p), k, s) for p, k, s in rows]
    return spark.createDataFrame(rows, CHANGES).withColumn("captured_at", F.current_timestamp())


def project_changes(spark: SparkSession, repos: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [changes(spark, r, absolute=True) for r in repos])


def log(spark: SparkSession, repo: str, limit: int = 50) -> DataFrame:
    lines = [x.split("\x1f") for x in _git(repo, "log", f"-{limit}", "--format=%H%x1f%an%x1f%at%x1f%s").splitlines()]
    return spark.createDataFrame([(k, a, b, int(t), m) for k, (a, b, t, m) in enumerate(lines)], "pos int, id string, author string, epoch long, message string")


def branches(spark: SparkSession, repo: str) -> DataFrame:
    lines = [x.split("\x1f") for x in _git(repo, "branch", "-a", "--format=%(refname)%1f%(HEAD)%1f%(objectname)").splitlines()]
    rows = [(r.split("/", 2)[-1], h == "*", r.startswith("refs/remotes/"), c) for r, h, c in lines]
    return spark.createDataFrame(rows, "name string, is_current boolean, is_remote boolean, commit string")


def diff(spark: SparkSession, repo: str, staged: bool = False) -> DataFrame:
    """One row: the patch and its files, insertions and deletions."""
    text = _git(repo, "diff", *(["--cached"] if staged else []))
    return spark.createDataFrame([(text,)], "patch string").select("patch", *diff_counts("patch"))


def diff_counts(patch: str) -> list:
    lines = F.split(patch, "\n")
    n = lambda f: F.size(F.filter(lines, f))
    return [
        n(lambda x: x.startswith("diff --git ")).alias("files"), n(lambda x: x.startswith("+") & ~x.startswith("+++")).alias("insertions"), n(lambda x: x.startswith("-") & ~x.startswith("---")).alias("deletions"),
    ]


def head(repo: str) -> str:
    return _git(repo, "rev-parse", "HEAD")[:8]


def summary(rows: DataFrame) -> DataFrame:
    """One row: modified, added, deleted, untracked; renames count nowhere."""
    return rows.agg(*[F.count_if(F.col("kind") == k).alias(k.lower()) for k in ("Modified", "Added", "Deleted", "Untracked")])


def count_repos(files: DataFrame, repos: DataFrame) -> DataFrame:
    """One row: the number of repositories that hold a file, 1 at least."""
    from ..operators.joins import longest_prefix

    return longest_prefix(files, repos).agg(F.greatest(F.lit(1), F.count_distinct("root")).alias("repos"))


def _done(repo: str, *args: str) -> bool:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True).returncode == 0


def add(repo: str, paths: list[str]) -> bool:
    """Stages paths; whether that worked."""
    return _done(repo, "add", "--", *paths)


def commit(repo: str, message: str, author: str = "skein <skein@localhost>") -> str | None:
    """Commits what is staged; the new head, None if there is nothing to commit."""
    name, _, mail = author.partition(" <")
    made = _done(repo, "-c", f"user.name={name}", "-c", f"user.email={mail.rstrip('>')}", "commit", "-m", message)
    return head(repo) if made else None


def reset(repo: str, paths: list[str] | None = None) -> bool:
    """Unstages paths, or all; files stay as they are."""
    return _done(repo, "reset", "-q", "HEAD", "--", *(paths or ["."]))


def checkout(repo: str, branch: str, create: bool = False) -> bool:
    """Changes to a branch; one that is checked out nowhere and not asked to be made fails."""
    return _done(repo, "checkout", "-q", *(["-b"] if create else []), branch)


def absolute(rows: DataFrame, root: str) -> DataFrame:
    """rows with ``path`` below the root, absolute ones as they are."""
    return rows.withColumn("path", F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "path")))
