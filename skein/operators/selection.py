"""Selections of nodes and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_programmatic(nodes: DataFrame, ids: DataFrame) -> tuple[DataFrame, int]:
    """A new base selection, of the given ids that exist, and its depth: 0."""
    return nodes.select("id").join(ids.select("id").distinct(), "id", "left_semi"), 0


def differs(a: DataFrame, b: DataFrame) -> bool:
    """Whether two selections are different sets."""
    one, other = a.select("id").distinct(), b.select("id").distinct()
    return not (one.join(other, "id", "left_anti").isEmpty() and other.join(one, "id", "left_anti").isEmpty())


def sync(own: DataFrame, shown: DataFrame) -> tuple[DataFrame, bool]:
    """The selection that is shown, and whether it differs from the own one; the own one stays if not."""
    changed = differs(own, shown)
    return (shown if changed else own).select("id").distinct(), changed


def update_activations(nodes: DataFrame, state: DataFrame) -> DataFrame:
    """nodes (id, activation, ...) with the state's activations laid over; nodes that it lacks keep theirs."""
    new = state.select("id", F.col("activation").alias("__new"))
    return nodes.join(new, "id", "left").withColumn("activation", F.coalesce("__new", "activation")).drop("__new").select(*nodes.columns)


def label_visible(mode: str, rank: Column, selected: Column, hovered: Column | None = None, most: int = 50) -> Column:
    """all: up to ``most`` by rank, and what is selected; selected: that alone; none: nothing; what is hovered over always."""
    shown = {"all": (rank < most) | selected, "selected": selected, "none": F.lit(False)}
    if mode not in shown:
        raise ValueError(f"no such mode: {mode}")
    return shown[mode] | (hovered if hovered is not None else F.lit(False))
