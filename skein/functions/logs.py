"""Errors in captured build logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of compilers and runtimes, with the groups of file, line, severity and message.
PATTERNS = (
    (r"(error|warning)(?:\[E\d+\])?: (.+)\n\s*--> (.+):(\d+):\d+", 3, 4, 1, 2),
    (r"([^\s:]+):(\d+):\d+: (error|warning): (.+)", 1, 2, 3, 4),
    (r'File "(.+)", line (\d+)', 1, 2, 0, 0),
    (r"([^\s]+\.go):(\d+):\d+: (.+)", 1, 2, 0, 3),
    (r"(.+)\((\d+),\d+\): error TS\d+: (.+)", 1, 2, 0, 3),
)


def success(exit_code: Column) -> Column:
    return F.coalesce(exit_code == 0, F.lit(False))


def crashed(exit_code: Column) -> Column:
    return F.coalesce(exit_code != 0, F.lit(False))


def errors_of(text: Column, parser: int) -> Column:
    """file, line, severity, message of each match of one pattern."""
    pattern, f, n, s, m = PATTERNS[parser]
    get = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    zipped = F.arrays_zip(get(f).alias("file"), get(n).alias("line"), (get(s) if s else get(f)).alias("severity"), (get(m) if m else get(f)).alias("message"))
    severity = lambda x: F.when(x["severity"] == "warning", "Warning").otherwise("Error") if s else F.lit("Error")
    message = lambda x: F.trim(x["message"]) if m else F.lit("Python error")
    return F.transform(zipped, lambda x: F.struct(x["file"].alias("file"), F.coalesce(x["line"].try_cast("int"), F.lit(0)).alias("line"), severity(x).alias("severity"), message(x).alias("message")))


def parse_errors(logs: DataFrame) -> DataFrame:
    """script, pos, file, line, message, severity of logs (name, stdout, stderr): all parsers, one row for each (file, line, message), the first parser's."""
    text = F.concat_ws("\n", F.coalesce("stderr", F.lit("")), F.coalesce("stdout", F.lit("")))
    every = F.flatten(F.array(*[F.transform(errors_of(F.col("__t"), k), lambda x, k=k: F.struct(F.lit(k).alias("parser"), x["file"].alias("file"), x["line"].alias("line"), x["severity"].alias("severity"), x["message"].alias("message"))) for k in range(len(PATTERNS))]))
    rows = logs.withColumn("__t", text).select(F.col("name").alias("script"), F.posexplode(every).alias("pos", "e")).select("script", "pos", "e.*")
    return rows.groupBy("script", "file", "line", "message").agg(F.min_by("severity", F.struct("parser", "pos")).alias("severity"), F.min("pos").alias("pos"))


def with_failures(logs: DataFrame, errors: DataFrame) -> DataFrame:
    """The errors and one row ``<script:name>`` for each failed script without any."""
    from .scalars import diagnostic_line

    failed = logs.where(~success(F.col("exit_code"))).join(errors.select(F.col("script").alias("name")), "name", "left_anti")
    text = F.concat_ws("\n", F.coalesce("stderr", F.lit("")), F.coalesce("stdout", F.lit("")))
    made = failed.select(F.col("name").alias("script"), F.concat(F.lit("<script:"), "name", F.lit(">")).alias("file"), F.lit(0).alias("line"), F.coalesce(diagnostic_line(text), F.lit("script failed")).alias("message"), F.lit("Error").alias("severity"), F.lit(0).alias("pos"))
    return errors.unionByName(made)


def feedback(logs: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: passed, failed, errors."""
    a = logs.agg(F.count_if(success(F.col("exit_code"))).alias("passed"), F.count_if(~success(F.col("exit_code"))).alias("failed"))
    return a.join(F.broadcast(errors.agg(F.count(F.lit(1)).alias("errors"))))


def errored_files(errors: DataFrame) -> DataFrame:
    return errors.select("file").distinct().orderBy("file")


def summary_line(logs: DataFrame, errors: DataFrame, *run: str) -> DataFrame:
    """``name: ok`` or ``name: n errors`` of each script in order, a row for each run (columns of ``logs``; none: one run); the
    scripts of one run are few."""
    n = errors.groupBy("script").agg(F.count(F.lit(1)).alias("n"))
    own = logs.join(n, logs.name == n.script, "left").select(*run, "pos", F.concat("name", F.lit(": "), F.when(success(F.col("exit_code")), F.lit("ok")).otherwise(F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" errors")))).alias("x"))
    return own.groupBy(*run).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]), " | ").alias("summary"))


def merge_crash(errors: DataFrame, crashes: DataFrame) -> DataFrame:
    return errors.unionByName(crashes)
