"""Project configuration: TOML files, defaults by what lies in the folder, and both together."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.planning import OBJECTIVE

#: Marker files by project type, the first present wins; scripts by type; the configuration file; known script names.
MARKERS = (("rust", ("Cargo.toml",)), ("node", ("package.json",)), ("python", ("pyproject.toml", "setup.py")), ("go", ("go.mod",)), ("make", ("Makefile",)), ("compose", ("docker-compose.yml", "compose.yaml")))
SCRIPTS = {
    "rust": {"build": "cargo build", "test": "cargo test", "check": "cargo check", "lint": "cargo clippy"}, "node": {"build": "npm run build", "test": "npm test"}, "python": {"test": "pytest", "lint": "ruff check ."},
    "go": {"build": "go build ./...", "test": "go test ./...", "lint": "go vet ./..."}, "make": {"build": "make", "test": "make test"}, "compose": {"up": "docker compose up"},
}
WATCH = {"rust": ["check", "test"], "node": ["test"], "python": ["test"], "go": ["test"], "make": ["test"], "compose": []}
CONFIG_FILE = "vg.toml"
NPM_NAMES = ("build", "test", "lint", "dev", "start", "check")


@dataclass
class ProjectConfig:
    name: str
    scripts: dict[str, str] = field(default_factory=dict)
    watch: list[str] = field(default_factory=list)
    process: str | None = None
    stability: dict[str, float] = field(default_factory=dict)
    ignore: list[str] = field(default_factory=list)
    automaton: dict = field(default_factory=dict)

    def objective(self) -> dict[str, float]:
        return OBJECTIVE | self.stability

    def watch_scripts(self) -> list[tuple[str, str]]:
        return [(n, self.scripts[n]) for n in self.watch if n in self.scripts]

    def has_watch_scripts(self) -> bool:
        return bool(self.watch_scripts())

    def objective_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.objective().items()), "role string, target double")


def load(folder: str) -> ProjectConfig | None:
    """The configuration file of a folder; the name defaults to the folder's."""
    path = os.path.join(folder, CONFIG_FILE)
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    project = raw.get("project", {})
    return ProjectConfig(project.get("name") or os.path.basename(os.path.abspath(folder)), dict(raw.get("scripts", {})), list(raw.get("watch", {}).get("run", [])), raw.get("process", {}).get("cmd"), {k: float(v) for k, v in raw.get("stability", {}).items()}, list(raw.get("ignore", {}).get("patterns", [])), dict(raw.get("automaton", {})))


def detect_type(folder: str) -> str | None:
    return next((kind for kind, names in MARKERS if any(os.path.exists(os.path.join(folder, n)) for n in names)), None)


def package_scripts(folder: str) -> dict[str, str]:
    """Known scripts that package.json has."""
    try:
        with open(os.path.join(folder, "package.json"), encoding="utf-8") as f:
            have = json.load(f).get("scripts", {})
    except (OSError, ValueError):
        return {}
    return {n: f"npm run {n}" for n in NPM_NAMES if n in have}


def infer(folder: str) -> ProjectConfig:
    kind = detect_type(folder)
    scripts = (package_scripts(folder) if kind == "node" else {}) or dict(SCRIPTS.get(kind, {}))
    return ProjectConfig(os.path.basename(os.path.abspath(folder)), scripts, [w for w in WATCH.get(kind, []) if w in scripts], "docker compose up" if kind == "compose" else None)


def resolve(folder: str, workspace: str | None = None) -> ProjectConfig:
    """The folder's file, else the workspace's defaults under the folder's name, else what is inferred."""
    own = load(folder)
    if own:
        return own
    above = load(workspace) if workspace else None
    inferred = infer(folder)
    return replace(above, name=inferred.name, scripts=above.scripts or inferred.scripts, watch=above.watch or inferred.watch) if above else inferred


def to_toml(c: ProjectConfig) -> str:
    """Text with sorted keys."""
    q = json.dumps
    out = ["[project]", f"name = {q(c.name)}"]
    if c.scripts:
        out += ["", "[scripts]", *[f"{k} = {q(v)}" for k, v in sorted(c.scripts.items())]]
    if c.watch:
        out += ["", "[watch]", f"run = {q(c.watch)}"]
    if c.process:
        out += ["", "[process]", f"cmd = {q(c.process)}"]
    if c.stability:
        out += ["", "[stability]", *[f"{k} = {v}" for k, v in sorted(c.stability.items())]]
    if c.ignore:
        out += ["", "[ignore]", f"patterns = {q(c.ignore)}"]
    return "\n".join(out) + "\n"
