"""Scanning folders and repositories into tables of sources, and sources into graphs."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, scalars
from ..graph import CONTAINS, Graph
from ..operators import joins

#: Folders that are never entered.
SKIPPED = frozenset("node_modules target dist build __pycache__ .venv venv .git vendor .next coverage .turbo pkg .cargo".split())
CONTENT_BYTES = 100 * 1024
SOURCES = "repo string, path string, relative_path string, name string, size long"


@dataclass
class ScanOptions:
    exclude: set[str] = field(default_factory=set)
    extensions: set[str] | None = None
    max_size: int | None = None
    include_hidden: bool = False

    def enters(self, name: str) -> bool:
        return name not in SKIPPED and name not in self.exclude and (self.include_hidden or not name.startswith("."))

    def keeps(self, name: str, size: int) -> bool:
        ext = name.rpartition(".")[2] if "." in name[1:] else ""
        hidden = name.startswith(".") and not self.include_hidden
        return not hidden and name not in self.exclude and (self.extensions is None or ext in self.extensions) and (self.max_size is None or size <= self.max_size)


def scan(spark: SparkSession, root: str, repo: str | None = None, options: ScanOptions | None = None) -> DataFrame:
    """The files of a local folder (see SOURCES). Skipped folders are not entered, so the walk is the pruning."""
    o, rows = options or ScanOptions(), []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(f for f in folders if o.enters(f))
        for name in sorted(names):
            path = os.path.join(folder, name)
            if os.path.isfile(path) and not os.path.islink(path) and o.keeps(name, size := os.path.getsize(path)):
                rows.append((repo or os.path.basename(os.path.abspath(root)), path, os.path.relpath(path, root), name, size))
    return spark.createDataFrame(rows, SOURCES)


def scan_store(spark: SparkSession, root: str, repo: str, glob: str = "*", options: ScanOptions | None = None) -> DataFrame:
    """The same for folders that only Spark reaches: listed in parallel, contents neither read nor shuffled."""
    o = options or ScanOptions()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("size"))
    relative = F.regexp_replace(F.expr(f"substring(path, instr(path, '{root.split('://')[-1].strip('/')}') + {len(root.split('://')[-1].strip('/'))})"), "^/+", "")
    rows = files.select(F.lit(repo).alias("repo"), "path", relative.alias("relative_path"), scalars.file_name("path").alias("name"), "size")
    parts = F.split("relative_path", "/")
    bad = F.exists(parts, lambda p: is_skipped(p, o.exclude) | (is_hidden(p) & (not o.include_hidden)))
    rows = rows.where(~bad)
    if o.extensions is not None:
        rows = rows.where(scalars.extension("name").isin(*o.extensions))
    return rows.where(F.col("size") <= o.max_size) if o.max_size is not None else rows


def with_content(spark: SparkSession, sources: DataFrame, most: int = CONTENT_BYTES) -> DataFrame:
    """sources with ``content``: the text of files of at most ``most`` bytes that hold no zero byte, else null."""
    paths = [r[0] for r in sources.where(F.col("size") <= most).select("path").toLocalIterator()]
    if not paths:
        return sources.withColumn("content", F.lit(None).cast("string"))
    files = reduce(DataFrame.unionByName, [spark.read.format("binaryFile").load(paths[k : k + 5000]) for k in range(0, len(paths), 5000)])
    text = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.when(is_text("content"), F.col("content")).alias("raw"))
    return sources.join(text.select("path", F.decode("raw", "UTF-8").alias("content")), "path", "left")


def is_text(content: str) -> Column:
    """Whether a binary column looks like text: no zero byte in it."""
    return F.length(F.regexp_replace(F.hex(content), "(..)", "$1 ")).isNotNull() & ~F.contains(F.concat(F.lit(" "), F.regexp_replace(F.hex(content), "(..)", "$1 ")), F.lit(" 00 "))


def totals(sources: DataFrame) -> DataFrame:
    return sources.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def workspace(path: str) -> dict:
    """single for a repository, multi for a folder of repositories (sorted), else plain."""
    if os.path.isdir(os.path.join(path, ".git")):
        return {"kind": "single", "repos": [os.path.basename(os.path.abspath(path))]}
    repos = sorted(n for n in (os.listdir(path) if os.path.isdir(path) else []) if os.path.isdir(os.path.join(path, n, ".git")))
    return {"kind": "multi", "repos": repos} if repos else {"kind": "plain", "repos": []}


def sync(spark: SparkSession, path: str, options: ScanOptions | None = None) -> DataFrame:
    """A folder's sources, or those of all its repositories."""
    w = workspace(path)
    if w["kind"] != "multi":
        return scan(spark, path, options=options)
    return reduce(DataFrame.unionByName, [scan(spark, os.path.join(path, r), r, options) for r in w["repos"]])


class Remote:
    """What a code host offers; a client of one's own answers list (a page of repository names) and fetch (a folder with one)."""

    def list(self, org: str, page: int, per_page: int) -> list[str]:
        raise NotImplementedError

    def fetch(self, org: str, repo: str) -> str:
        raise NotImplementedError


PER_PAGE, MOST_PAGES = 100, 10


def list_remote(remote: Remote, org: str, ignore: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """An organisation's repositories, but for ignored ones: pages of PER_PAGE until one is not full, MOST_PAGES at most."""
    out: list[str] = []
    for page in range(1, MOST_PAGES + 1):
        got = remote.list(org, page, PER_PAGE)
        out += [r for r in got if r not in ignore]
        if len(got) < PER_PAGE:
            break
    return out


def sync_remote(spark: SparkSession, remote: Remote, value: str, ignore: frozenset[str] | set[str] = frozenset(), options: ScanOptions | None = None) -> DataFrame:
    """The sources of a repository, or of all of an organisation's, fetched by ``remote``."""
    s = sync_source(value)
    if s["type"] == "local":
        return sync(spark, s["path"], options)
    repos = [s["repo"]] if s["type"] == "repo" else list_remote(remote, s["org"], ignore)
    parts = [scan(spark, remote.fetch(s["org"], r), r, options) for r in repos]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SOURCES)


def is_hidden(name: Column) -> Column:
    return name.startswith(".")


def is_skipped(name: Column, exclude: set[str] | frozenset[str] = frozenset()) -> Column:
    """Whether a folder of this name is never entered."""
    return name.isin(*SKIPPED, *exclude)


def resolve_file_path(absolute: str | None, workspace: str, relative: str) -> str:
    """The absolute path if there is a file, else the relative one below the workspace."""
    return absolute if absolute and os.path.exists(absolute) else os.path.join(workspace, relative)


def sync_source(value: str) -> dict:
    """local for a path that looks local or exists; one name an organisation; two or more a repository."""
    if value.startswith((".", "/", "~")) or os.path.exists(value):
        return {"type": "local", "path": value}
    clean = re.sub(r"^(https?://)?(www\.)?github\.com/|^git@github\.com:", "", value).removesuffix(".git").strip("/")
    parts = [p for p in clean.split("/") if p]
    return {"type": "org", "org": parts[0]} if len(parts) == 1 else {"type": "repo", "org": parts[0], "repo": parts[1]} if parts else {"type": "local", "path": value}


def remote_info(url: str) -> dict:
    """A remote's plain https form, whether it names an organisation, and that."""
    s = sync_source(url if "/" in url or ":" in url else f"https://github.com/{url}")
    org = s.get("org", "")
    path = f"{org}/{s['repo']}" if s["type"] == "repo" else org
    return {"url": f"https://github.com/{path}", "is_org": s["type"] == "org", "org": org}


def ignore_list(spark: SparkSession, given: list[str], *files: str) -> DataFrame:
    """name: given ones and the lines of files, without blanks and comments."""
    rows = spark.createDataFrame([(x,) for x in given], "name string")
    for f in files:
        rows = rows.unionByName(spark.read.text(f).select(F.trim("value").alias("name")))
    return rows.where((F.col("name") != "") & ~F.col("name").startswith("#")).distinct()


def read_file(root: str, relative: str, most: int = 1 << 20) -> dict:
    """One file below a root: its text, lines and language. Paths that leave the root, and larger files, are refused."""
    full = os.path.realpath(os.path.join(root, relative))
    if os.path.commonpath([full, os.path.realpath(root)]) != os.path.realpath(root):
        raise PermissionError("path leaves the root")
    if os.path.getsize(full) > most:
        raise ValueError("file is too large")
    with open(full, encoding="utf-8", errors="replace") as f:
        text = f.read()
    name = os.path.basename(full).lower()
    special = {"dockerfile": "dockerfile", "makefile": "makefile"}
    return {"path": relative, "content": text, "lines": len(text.split("\n")), "language": special.get(name) or {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript", "md": "markdown"}.get(name.rpartition(".")[2], "txt")}


def build_graph(sources: DataFrame) -> Graph:
    """All folders above the files, the files, containment, and references that resolve; sources: relative_path, name, content.

    Ids are dense in (directory first, path) order of the distinct paths.
    """
    from ..operators.layout import dense_ids

    files = sources.groupBy(F.col("relative_path").alias("path")).agg(F.first("name").alias("name"), F.first("content").alias("content"))
    folders = joins.ancestors(files).select("path", scalars.file_name("path").alias("name"))
    every = folders.select("path", "name", F.lit("Directory").alias("kind"), F.lit(None).cast("string").alias("content")).unionByName(files.select("path", "name", scalars.node_kind("path", "name").alias("kind"), "content"))
    keyed = dense_ids(every.select(F.struct((F.col("kind") != "Directory").alias("f"), "path").alias("id"))).select(F.col("id.path").alias("path"), F.col("index").cast("long").alias("id"))
    nodes = every.join(keyed, "path").withColumn("pos", F.col("id"))
    tests = F.coalesce(scalars.has_inline_tests(F.col("content"), F.col("path")), F.lit(False))
    plain = nodes.select("id", "pos", "name", "kind", "path", scalars.extension("path").alias("extension"), scalars.language("path").alias("language"), tests.alias("has_tests"))
    refs = code.reference_rows(nodes.where("content is not null").select("id", "path", "content"))
    linked = joins.resolve_routes(refs, plain.select("id", "pos", "path")).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("kind").alias("relationship"))
    edges = joins.hierarchy(plain).unionByName(linked.distinct())
    return Graph(plain, edges.withColumn("pos", F.when(F.col("relationship") == CONTAINS, 0).otherwise(1)))
