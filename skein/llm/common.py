"""What the operators of this subpackage share: reading, the shared folder, and cutting lineage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_top, ship

#: Rows and bytes of one Arrow batch that a Python worker holds.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches handed to Python workers, whatever the rows' lengths, and sends them this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see, removed when the session ends."""
    top = shared_top(spark)
    path = f"{top}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_noted: list[list[str]] = []


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: survives lost executors, no lineage behind it."""
    folder = shared_dir(spark, name)
    for notes in _noted:
        notes.append(folder)
    df.write.parquet(f"{folder}/table")
    out = spark.read.schema(df.schema).parquet(f"{folder}/table")
    out.cut_folder = folder
    return out


def free(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables that cut() wrote, once all that was made of them is written out itself."""
    for t in tables:
        remove(spark, t.cut_folder)


@contextmanager
def noted():
    """The folders that cut() makes meanwhile, as a list that grows."""
    notes: list[str] = []
    _noted.append(notes)
    try:
        yield notes
    finally:
        _noted.remove(notes)


def file_system(uri: str):
    """pyarrow's file system for a folder and the path in it; works in executors, with any scheme pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


_held: dict = {}


def held(key, make):
    """What ``make`` gives, kept by a worker process for its next tasks until it asks for something else: one thing at a time."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drops what ``held`` kept for another operator, and gives memory that other operators' tasks left in this worker back."""
    import ctypes
    import gc

    import pyarrow

    _held.clear()
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the crc32 of a text's UTF-8 bytes."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda r, bit: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)"
    octets = f"list_transform(range(CAST(octet_length(encode({text})) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: {bits}), 4294967295)"
