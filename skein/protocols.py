"""What a user may plug in around graphs: mappers to regions, scanners, materialisers, test runners."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph

REGIONS = "region string, id long"
NODES = "id long, pos long, name string, kind string, path string"
EDGES = "src long, dst long, relationship string, pos long"


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))


class SemanticMapper(ABC):
    """Names regions of a graph: rows of REGIONS, a node in any number of them."""

    @abstractmethod
    def extract_regions(self, g: Graph) -> DataFrame: ...


class NoRegions(SemanticMapper):
    def extract_regions(self, g: Graph) -> DataFrame:
        return g.nodes.select(F.lit("").alias("region"), "id").limit(0)


class FolderRegions(SemanticMapper):
    """A region for each first folder of a path."""

    def extract_regions(self, g: Graph) -> DataFrame:
        return g.nodes.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("region"), "id")


class SourceScanner(ABC):
    @abstractmethod
    def scan_repo(self, spark: SparkSession, folder: str) -> Graph: ...


class EmptyScanner(SourceScanner):
    """Scans nothing."""

    def scan_repo(self, spark: SparkSession, folder: str) -> Graph:
        return empty_graph(spark)


class FolderScanner(SourceScanner):
    """The graph of a folder's files."""

    def scan_repo(self, spark: SparkSession, folder: str) -> Graph:
        from .sources import scan

        return scan.build_graph(scan.with_content(spark, scan.scan(spark, folder)))


class Materializer(ABC):
    """Applies proposed changes (path, content; null content deletes) to a folder; how many were applied."""

    @abstractmethod
    def apply_proposed_changes(self, changes: DataFrame, folder: str) -> int: ...


class FileMaterializer(Materializer):
    """Writes and deletes files below the folder; a path that leaves it is refused before anything is written. Rows stream to the driver."""

    def apply_proposed_changes(self, changes: DataFrame, folder: str) -> int:
        import os

        top, done = os.path.realpath(folder), 0
        places = lambda: ((r, os.path.realpath(os.path.join(top, r["path"]))) for r in changes.select("path", "content").toLocalIterator())
        if any(os.path.commonpath([top, at]) != top for _, at in places()):
            raise PermissionError("a path leaves the folder")
        for r, at in places():
            if r["content"] is None:
                if os.path.exists(at):
                    os.remove(at)
                    done += 1
                continue
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w", encoding="utf-8") as f:
                f.write(r["content"])
            done += 1
        return done


class TestRunner(ABC):
    """Runs a folder's tests: rows of scripts.LOGS."""

    @abstractmethod
    def run_tests(self, spark: SparkSession, folder: str) -> DataFrame: ...


class ScriptRunner(TestRunner):
    """The script named test, of the folder's configuration."""

    def run_tests(self, spark: SparkSession, folder: str) -> DataFrame:
        from .sources import project, scripts

        own = project.resolve(folder).scripts
        return scripts.run_scripts(spark, [("test", own["test"])] if "test" in own else [], folder)
