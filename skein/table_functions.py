"""Operators as table functions of SQL: ``SELECT * FROM regions(TABLE(nodes) PARTITION BY kind)``.

Each takes a table, partitioned by SQL, and checks its columns when the query is analysed; what it gives has the types that its
input has. A partition streams through: only counts, or the last row, are held.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .session import ship


def _column(table: AnalyzeArgument, name: str, *kinds: type) -> StructField:
    """A column of a table argument; an analysis error if it is missing or of another type."""
    if not table.isTable:
        raise ValueError("the first argument must be a table: TABLE(..)")
    found = next((f for f in table.dataType.fields if f.name == name), None)
    if found is None:
        raise ValueError(f"the table has no column {name}: {', '.join(f.name for f in table.dataType.fields)}")
    if kinds and not isinstance(found.dataType, kinds):
        raise ValueError(f"column {name} is {found.dataType.simpleString()}")
    return found


class Regions:
    """Counts of a partition's rows by the first ``depth`` folders of their path: by (the partition's value of that column, if one
    is named), region, n and the least id, of the type that ids have. A null path is the region ''."""

    def __init__(self):
        self.found: dict = {}
        self.of = None
        self.by: str | None = None

    @staticmethod
    def analyze(table: AnalyzeArgument, depth: AnalyzeArgument | None = None, by: AnalyzeArgument | None = None) -> AnalyzeResult:
        _column(table, "path", StringType)
        fields = [StructField("region", StringType()), StructField("n", LongType()), StructField("first_id", _column(table, "id").dataType)]
        if by is not None:
            fields.insert(0, StructField(by.value, _column(table, by.value).dataType))
        if depth is not None and (not isinstance(depth.dataType, IntegerType | LongType) or depth.value < 1):
            raise ValueError("depth must be 1 or more")
        return AnalyzeResult(StructType(fields))

    def eval(self, row, depth: int = 1, by: str | None = None):
        self.by = by
        self.of = row[by] if by else None
        region = "/".join((row["path"] or "").split("/")[:depth])
        n, first = self.found.get(region, (0, None))
        self.found[region] = (n + 1, row["id"] if first is None else min(first, row["id"]))

    def terminate(self):
        for region, (n, first) in sorted(self.found.items()):
            yield (self.of, region, n, first) if self.by else (region, n, first)


#: Rows of a shelf, on average.
SHELF = 10_000


def shelf(path: Column, depth: int, rows: int) -> Column:
    """A number that all paths of a region have in common: partitioned by it too, a table of so many ``rows`` is dealt over many
    partitions with few regions each, and a region's count is whole still."""
    region = F.substring_index(F.coalesce(path, F.lit("")), "/", depth)
    return F.pmod(F.xxhash64(region), F.lit(max(1, -(-rows // SHELF))))


class OnlyChanges:
    """The rows of a partition whose ``fingerprint`` differs from the row's before, in the order that SQL gives: all columns of the
    table as they are."""

    def __init__(self):
        self.last = None

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        _column(table, "fingerprint")
        return AnalyzeResult(table.dataType)

    def eval(self, row):
        if row["fingerprint"] != self.last:
            self.last = row["fingerprint"]
            yield tuple(row)

    def terminate(self):
        return
        yield


FUNCTIONS = {"regions": Regions, "only_changes": OnlyChanges}


def register(spark: SparkSession) -> list[str]:
    """Registers all table functions for a session's SQL; their names."""
    ship(spark)
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made))
    return list(FUNCTIONS)
