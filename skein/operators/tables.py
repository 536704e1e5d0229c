"""Tables that cut lineage: written to the session's shared folder, taken away once spent, and all of them when the session ends."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..session import shared_top


def _folder(spark) -> str:
    """A new folder in the shared one, with a mark to go at exit."""
    path = f"{shared_top(spark)}/table-{uuid.uuid4().hex[:12]}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """The same rows, written and read again: a lost executor repeats what is read from here on only, and the planner knows the
    table's size, so that it sends small ones to the tasks. ``by``: in buckets of a column, so that joins and sums on it need no
    shuffle of this table."""
    spark = df.sparkSession
    folder = _folder(spark)
    if by is None:
        df.write.parquet(f"{folder}/rows")
        out = spark.read.schema(df.schema).parquet(f"{folder}/rows")
        out.cut_name = None
    else:
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"skein_{uuid.uuid4().hex[:12]}"
        df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", f"{folder}/rows").saveAsTable(name)
        out = spark.table(name)
        out.cut_name = name
    out.cut_folder = folder
    return out


#: Bytes from which a table that is joined again and again is worth buckets; smaller ones may even go to the tasks whole.
LARGE = 64 << 20


def size_of(table: DataFrame) -> int:
    """Bytes of a table that ``cut`` wrote."""
    spark = table.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.cut_folder)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def laid_out(df: DataFrame, by: str, near: str | None = None, size: int | None = None) -> DataFrame:
    """``cut``, in buckets of ``by`` where the table is large (see ``in_buckets``); else rows of one ``near`` lie together, so
    that what is summed by it is summed before the shuffle. ``size``: its bytes, where they are known; else it is written to see."""
    if size is not None and size >= LARGE:
        return cut(df, by)
    plain = cut(df.repartition(near) if near else df)
    if size is not None or size_of(plain) < LARGE:
        return plain
    out = cut(plain, by)
    free(plain)
    return out


def in_buckets(table: DataFrame) -> bool:
    return getattr(table, "cut_name", None) is not None


def summed(df: DataFrame, *sums: Column, by: str | None = None) -> tuple[DataFrame, Row]:
    """``cut``, and sums over the rows that the same pass takes."""
    seen = Observation()
    out = cut(df.observe(seen, *sums), by)
    return out, Row(**seen.get)


def free(*tables: DataFrame | None) -> None:
    """Takes tables away that ``cut`` wrote, once nothing reads them any more; others are left alone."""
    for t in tables:
        folder = getattr(t, "cut_folder", None)
        if folder:
            spark = t.sparkSession
            if t.cut_name:
                spark.sql(f"DROP TABLE IF EXISTS {t.cut_name}")
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            t.cut_folder = None
