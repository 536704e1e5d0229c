"""What a user calls: projects by name, tools and resources over their graphs, and an engine of intents and ticks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import CONTAINS, Graph
from .operators import degrees, joins, search, traversal, vectors
from .operators.automaton import Automaton, Registry, default_rules, initial_state, marked
from .operators.text_index import TextIndex
from .sources import scan, vcs
from .sources.store import Store

DEFAULTS = {"search_limit": 20, "impact_depth": 2, "context_depth": 1, "semantic_k": 10}


class Project:
    """A graph, where its files are, the vectors of its nodes (id, embedding) and an index of their texts, as far as there are any."""

    def __init__(self, name: str, graph: Graph, folder: str | None = None, index: DataFrame | None = None, texts: TextIndex | None = None):
        self.name, self.graph, self.folder, self.index, self.texts, self.synced = name, graph, folder, index, texts, time.time()

    def since_sync(self) -> float:
        return time.time() - self.synced


class Projects:
    """Projects by name; registering a name again replaces it."""

    def __init__(self):
        self.by_name: dict[str, Project] = {}

    def register(self, project: Project) -> None:
        self.by_name[project.name] = project

    def unregister(self, name: str) -> bool:
        return self.by_name.pop(name, None) is not None

    def names(self) -> list[str]:
        return sorted(self.by_name)

    def single(self) -> Project | None:
        return next(iter(self.by_name.values())) if len(self.by_name) == 1 else None

    def resolve(self, name: str | None = None) -> Project:
        """The named project, else the only one, else an error that lists the names."""
        if name is not None:
            if name not in self.by_name:
                raise KeyError(f"no project {name}; there are: {', '.join(self.names())}")
            return self.by_name[name]
        found = self.single()
        if found is None:
            raise KeyError(f"name a project; there are: {', '.join(self.names())}")
        return found


class Tools:
    """Tools and resources by name, over a project's graph. Results are DataFrames."""

    def __init__(self, spark: SparkSession, projects: Projects, embed: Callable[[str], list[float]] | None = None):
        self.spark, self.projects, self.embed = spark, projects, embed
        self.tools = {
            "search_nodes": self.search_nodes, "get_dependencies": self.get_dependencies, "impact_analysis": self.impact_analysis, "get_git_changes": self.get_git_changes, "get_node_context": self.get_node_context,
            "list_files": self.list_files, "semantic_search": self.semantic_search, "list_projects": self.list_projects,
        }

    def call(self, tool: str, project: str | None = None, **arguments) -> DataFrame:
        if tool not in self.tools:
            raise KeyError(f"no such tool: {tool}")
        if tool == "list_projects":
            return self.list_projects()
        return self.tools[tool](self.projects.resolve(project), **arguments)

    def list_projects(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.projects.names()], "name string")

    def search_nodes(self, p, query, kind=None, extension=None, limit=DEFAULTS["search_limit"]):
        if p.texts is not None:
            return p.texts.search_nodes(query, kind, extension, limit)
        return search.search_nodes(p.graph.nodes, query, kind, extension, limit)

    def list_files(self, p, path="", extension=None, kind=None, limit=DEFAULTS["search_limit"]):
        return search.list_files(p.graph.nodes, path, extension, kind, limit)

    def _node(self, p, path) -> int:
        row = search.find_by_path(p.graph.nodes, path).first()
        if row is None:
            raise KeyError(f"no node at {path}")
        return row["id"]

    def get_dependencies(self, p, path, direction="both"):
        return joins.dependencies(p.graph, self._node(p, path), direction)

    def impact_analysis(self, p, paths, depth=DEFAULTS["impact_depth"]):
        ids = [self._node(p, x) for x in paths]
        return traversal.impact(p.graph, p.graph.nodes.where(F.col("id").isin(ids)), depth)

    def get_node_context(self, p, path, depth=DEFAULTS["context_depth"]):
        return traversal.context(p.graph, self._node(p, path), depth).nodes

    def get_git_changes(self, p):
        return vcs.summary(vcs.changes(self.spark, p.folder))

    def semantic_search(self, p, query, k=DEFAULTS["semantic_k"], least=None):
        """By the index; by text where there is no index or no embedder."""
        if p.index is None or self.embed is None:
            return p.texts.run_search(query, k) if p.texts is not None else search.run_search(p.graph.nodes, query, k)
        return vectors.enrich(vectors.search(p.index, self.embed(query), k, least), p.graph.nodes)

    def resource(self, uri: str, project: str | None = None) -> DataFrame:
        """graph, graph/nodes, graph/edges, graph/metadata, health or git/changes."""
        p = self.projects.resolve(project)
        found = {
            "graph": lambda: degrees.graph_counts(p.graph), "graph/nodes": lambda: p.graph.nodes, "graph/edges": lambda: p.graph.edges, "graph/metadata": lambda: degrees.kind_counts(p.graph),
            "health": lambda: degrees.graph_counts(p.graph).withColumn("status", F.lit("ok")), "git/changes": lambda: vcs.changes(self.spark, p.folder),
        }
        if uri not in found:
            raise KeyError(f"no such resource: {uri}")
        return found[uri]()


class Ops:
    """Sync, graph, status, load and clean over a folder and its store."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.store = spark, folder, Store(spark, f"{folder.rstrip('/')}/.self")

    def sync(self, force: bool = False) -> DataFrame:
        return self.store.read_through("project", lambda: scan.sync(self.spark, self.folder), force)

    def graph(self, force: bool = False) -> Graph:
        if force or self.store.load_graph() is None:
            self.store.save_graph(scan.build_graph(scan.with_content(self.spark, self.sync(force))))
        return self.store.load_graph()

    def status(self) -> dict:
        return {"workspace": scan.workspace(self.folder), **self.store.stats()}

    def load(self) -> DataFrame | None:
        return self.store.load("project")

    def clean(self) -> None:
        self.store.clean()

    def git_changes(self) -> DataFrame:
        w = scan.workspace(self.folder)
        return vcs.project_changes(self.spark, [f"{self.folder}/{r}" for r in w["repos"]]) if w["kind"] == "multi" else vcs.changes(self.spark, self.folder)


class Engine:
    """Intents as events, ticks of the automaton, snapshots numbered by the log."""

    def __init__(self, graph: Graph, rules: Registry | None = None):
        self.run = Automaton(graph, rules or default_rules(), initial_state(graph.nodes))
        self.log: list[dict] = []

    def apply_intent(self, title: str, targets: DataFrame) -> None:
        """The nodes of ``targets`` (id) become active and changed; the log holds how many there are."""
        found, mine = marked(self.run.state, targets), F.col("mine")
        self.log.append({"type": "intent", "title": title, "targets": found.where(mine).count()})
        self.run.state = found.withColumn("activation", F.when(mine, F.lit(1.0)).otherwise(F.col("activation"))).withColumn("changed", mine | F.col("changed")).drop("mine")

    def tick(self):
        t = self.run.step()
        self.log.append({"type": "tick", "tick": t.tick, "transitions": t.transitions})
        return t

    def snapshot(self) -> tuple[int, DataFrame]:
        return len(self.log) + 1, self.run.state

    def events(self) -> list[str]:
        return [json.dumps(e, sort_keys=True) for e in self.log]


def migration_inspection(g: Graph, target: int) -> DataFrame:
    """One row for a migration target: its scores, what it depends on, what depends on it, its tests, and what to do."""
    from .operators import planning

    own = planning.migration_candidates(g).where(F.col("id") == target)
    uses, used = joins.related_paths(g, target), joins.related_paths(g, target, outward=False)
    tests = joins.nearby_tests(g).where(F.col("id") == target)
    side = lambda df, name: F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))
    advice = planning.recommendation(F.col("has_test"), F.col("cost"), F.col("dependents"))
    return own.join(side(uses, "dependencies")).join(side(used, "dependents")).join(side(tests, "tests")).withColumn("recommendation", advice)


def unresolved(g: Graph, raw: DataFrame) -> DataFrame:
    """Edges of ``raw`` that name a missing node."""
    ids = g.nodes.select("id")
    return raw.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(raw.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")).distinct()


__all__ = ["CONTAINS", "Engine", "Ops", "Project", "Projects", "Tools", "migration_inspection", "unresolved"]
