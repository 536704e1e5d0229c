"""Reports as Markdown and JSON text. Rows of a report are bounded by its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(rows: DataFrame, line: Column, order: list[Column], most: int) -> DataFrame:
    """One row, text: the first lines in order."""
    from ..operators.joins import ranked

    top = ranked(rows.orderBy(*order).limit(most), *order, name="__n").select("__n", line.alias("__x"))
    return top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__x"))), lambda r: r["__x"]), "\n").alias("text"))


def sources_markdown(sources: DataFrame) -> DataFrame:
    """relative_path and text: a heading and the content in a fence, for each source."""
    fence = F.concat(F.lit("## "), "relative_path", F.lit("\n\n```"), F.regexp_extract("name", r"\.([^.]*)$", 1), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n```\n"))
    return sources.select("relative_path", fence.alias("text"))


def sources_json(sources: DataFrame) -> DataFrame:
    return sources.select("relative_path", F.to_json(F.struct("relative_path", "name", "size", "content")).alias("text"))


def impact_markdown(report: DataFrame, most: int = 50) -> DataFrame:
    """A ranked table of the nodes that an impact reaches."""
    line = F.format_string("| %s | %s | %s | %.3f |", "path", "role", "level", "activation")
    body = _joined(report.where("level <> 'None'"), line, [F.desc("activation"), F.asc("id")], most)
    return body.select(F.concat(F.lit("# Impact\n\n| path | role | level | activation |\n|-|-|-|-|\n"), "text").alias("text"))


def plan_markdown(items: DataFrame, summary: DataFrame, most: int = 30) -> DataFrame:
    """The plan's first rows and a health bar of twenty cells."""
    line = F.format_string("| %s | %s | %.3f | %.3f | %s |", "path", "role", "gap", "priority", "action")
    body = _joined(items, line, [F.desc("priority"), F.desc("gap"), F.desc("in_degree"), F.asc("path"), F.asc("id")], most)
    cells = F.round(F.col("health") * 20).cast("int")
    bar = F.concat(F.lit("["), F.repeat(F.lit("#"), cells), F.repeat(F.lit("."), F.lit(20) - cells), F.lit("]"))
    return summary.select(bar.alias("bar"), "health", "below", "total").join(F.broadcast(body)).select(F.concat(F.lit("# Plan\n\nHealth "), "bar", F.format_string(" %.0f %%, %d of %d below target\n\n", F.col("health") * 100, "below", "total"), F.lit("| path | role | gap | priority | action |\n|-|-|-|-|-|\n"), "text").alias("text"))


def contracts_markdown(contracts: DataFrame) -> DataFrame:
    body = _joined(contracts, F.format_string("- **%s**: %d nodes, stability %.2f to %.2f", "role", "n", "low", "high"), [F.desc("n"), F.asc("role")], 100)
    return body.select(F.concat(F.lit("# Behavioural contracts\n\n"), "text").alias("text"))


def quality_markdown(quality: DataFrame) -> DataFrame:
    return quality.select(F.format_string("# Quality: %s\n\n- health %.3f\n- coverage %.3f\n- weighted gap %.3f\n- largest gap %.3f\n", "status", "health", "coverage", "weighted_gap", "max_gap").alias("text"))


def task_markdown(task: DataFrame) -> DataFrame:
    """From next_task's JSON."""
    t = task.select(F.from_json("task", "path string, role string, action string, gap double, priority double, steps array<string>").alias("t")).select("t.*")
    steps = F.array_join(F.transform("steps", lambda s, k: F.concat((k + 1).cast("string"), F.lit(". "), s)), "\n")
    return t.select(F.concat(F.format_string("# %s\n\n%s (%s, gap %.3f)\n\n", "action", "path", "role", "gap"), steps, F.lit("\n")).alias("text"))


def migration_markdown(ranked: DataFrame, most: int = 50) -> DataFrame:
    body = _joined(ranked, F.format_string("%d. %s — %s (ROI %.2f): %s", "rank", "path", "strategy", "roi", "reason"), [F.asc("rank")], most)
    return body.select(F.concat(F.lit("# Migration plan\n\n"), "text").alias("text"))
