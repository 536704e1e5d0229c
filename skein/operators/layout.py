"""Force-directed layout: exact or Barnes-Hut repulsion, springs, gravity, integration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import ship
from . import cell_tree
from .cell_tree import SOFT
from .tables import cut, free

AXES = ("x", "y")
#: Places and edges of a layout that one task runs by itself, for many steps a job.
ONE_TASK = 250_000


@dataclass(frozen=True)
class Config:
    dt: float = 0.016
    damping: float = 0.9
    repulsion: float = 1000.0
    attraction: float = 0.01
    theta: float = 0.8
    gravity: float = 0.1
    ideal_length: float = 50.0
    barnes_hut: bool = True
    depth: int = 12


def start(nodes: DataFrame, radius: float = 100.0) -> DataFrame:
    """id, x, y, vx, vy: places on a sunflower spiral by id, at rest."""
    k = F.col("id").cast("double")
    angle, r = k * 2.399963229728653, radius * F.sqrt(F.pmod(k, F.lit(1000.0)) / 1000.0 + 0.001)
    return nodes.select("id", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))


def bounds(at: DataFrame) -> DataFrame:
    """One row: the padded square that holds all places, and their mean."""
    a = at.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))
    return a.withColumn("side", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1.0)) * 1.1)


def cells(at: DataFrame, depth: int, side: float, x0: float, y0: float) -> DataFrame:
    """level, i, j, mass, x, y (centre of mass) of every occupied cell of a quadtree down to ``depth``."""
    return cell_tree.cells(at, AXES, depth, side, (x0, y0))


#: Queries of exact_repulsion that a task holds.
BLOCK = cell_tree.PUSHED


def exact_repulsion(at: DataFrame, queries: DataFrame, strength: float) -> DataFrame:
    """id, fx, fy of ``queries`` from all places, in pairs of blocks. Work is queries x places; repulsion() is for large graphs."""
    ship(at.sparkSession)
    return cell_tree.exact(at, queries, AXES, strength, BLOCK)


def repulsion(at: DataFrame, config: Config) -> DataFrame:
    """id, fx, fy by Barnes-Hut: cells accepted where width / distance < theta, the others opened."""
    ship(at.sparkSession)
    b = bounds(at).first()
    if not b["n"]:
        return at.select("id", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))
    return cell_tree.repulsion(at, AXES, config.depth, b["side"], (b["x0"], b["y0"]), config.theta, config.repulsion)


def springs(at: DataFrame, edges: DataFrame, config: Config) -> DataFrame:
    """id, fx, fy: pulls along edges towards the ideal length, on both ends; a loop pulls nothing."""
    a = at.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    b = at.select(F.col("id").alias("dst"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    e = edges.where("src <> dst").select("src", "dst").join(a, "src").join(b, "dst")
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    dist = F.sqrt(dx * dx + dy * dy + SOFT)
    pull = (dist - config.ideal_length) * config.attraction
    both = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), (dx / dist * pull).alias("fx"), (dy / dist * pull).alias("fy")), F.struct(F.col("dst").alias("id"), (-dx / dist * pull).alias("fx"), (-dy / dist * pull).alias("fy")))).alias("f"))
    return both.groupBy("f.id").agg(F.sum("f.fx").alias("fx"), F.sum("f.fy").alias("fy"))


def step(at: DataFrame, edges: DataFrame, config: Config = Config()) -> DataFrame:
    ship(at.sparkSession)
    push = repulsion(at, config) if config.barnes_hut else cell_tree.exact_among(at, AXES, config.repulsion)
    pull = springs(at, edges, config).select("id", F.col("fx").alias("px"), F.col("fy").alias("py"))
    j = at.join(push, "id").join(pull, "id", "left")
    return integrate(j, config)


def run(at: DataFrame, edges: DataFrame, config: Config = Config(), steps: int = 1) -> DataFrame:
    """Places after ``steps``. A graph whose counted places and edges are at most ONE_TASK is one task's work, with no job for
    a step; larger ones take a distributed step() at a time. Both compute the same forces."""
    if at.count() + edges.count() > ONE_TASK:
        for _ in range(steps):
            before, at = at, cut(step(at, edges, config))
            free(before)
        return at
    ship(at.sparkSession)
    places = at.select(F.lit(0).alias("one"), "id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "vx", "vy")]).groupBy("one")
    links = edges.select(F.lit(0).alias("one"), "src", "dst").groupBy("one")

    def simulate(left, right):
        import pyarrow as pa

        ids = left.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        p, v = (np.stack([left.column(c).to_numpy()[order] for c in names], axis=1) for names in (("x", "y"), ("vx", "vy")))
        ends = [right.column(c).to_numpy() for c in ("src", "dst")] if right.num_rows else [np.zeros(0, np.int64)] * 2
        at_ = [np.minimum(np.searchsorted(ids, e), max(0, len(ids) - 1)) for e in ends]
        known = (ends[0] != ends[1]) & (ids[at_[0]] == ends[0]) & (ids[at_[1]] == ends[1]) if len(ids) else np.zeros(0, bool)
        a, b = at_[0][known], at_[1][known]
        for _ in range(steps if len(ids) else 0):
            p, v = _moved(p, v, a, b, config)
        return pa.table({"id": ids, "x": p[:, 0], "y": p[:, 1], "vx": v[:, 0], "vy": v[:, 1]})

    return places.cogroup(links).applyInArrow(simulate, "id long, x double, y double, vx double, vy double")


def _moved(p: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Places and velocities after a step; edges join rows a and b."""
    low = p.min(axis=0)
    side = max(*(p.max(axis=0) - low), 1.0) * 1.1
    if config.barnes_hut:
        force = cell_tree.CellTree.of_places(p, config.depth, side, low).push(p, config.theta, config.repulsion)
    else:
        force = cell_tree.pairs_push(p, p, config.repulsion)
    d = p[b] - p[a]
    dist = np.sqrt((d * d).sum(axis=1) + SOFT)
    pull = d * ((dist - config.ideal_length) * config.attraction / dist)[:, None]
    for axis in range(2):
        force[:, axis] += np.bincount(a, pull[:, axis], minlength=len(p)) - np.bincount(b, pull[:, axis], minlength=len(p))
    v = (v + (force - p * config.gravity) * config.dt) * config.damping
    return p + v * config.dt, v


def integrate(j: DataFrame, config: Config) -> DataFrame:
    """Velocity and place after a step under forces fx, fy (push) and px, py (pull, may be null)."""
    force = lambda f, p, c: F.col(f) + F.coalesce(p, F.lit(0.0)) - F.col(c) * config.gravity
    vx, vy = (F.col("vx") + force("fx", "px", "x") * config.dt) * config.damping, (F.col("vy") + force("fy", "py", "y") * config.dt) * config.damping
    return j.select("id", (F.col("x") + vx * config.dt).alias("x"), (F.col("y") + vy * config.dt).alias("y"), vx.alias("vx"), vy.alias("vy"))


class Layout:
    """uninitialized, running, paused or converged; steps are cut, so lineage stays short."""

    def __init__(self, config: Config = Config()):
        self.config, self.state, self.at, self.edges, self.steps = config, "uninitialized", None, None, 0

    def init(self, g: Graph, at: DataFrame | None = None) -> "Layout":
        self.at, self.edges, self.state = at if at is not None else start(g.nodes), g.edges, "paused"
        return self

    def start(self) -> "Layout":
        if self.state == "paused":
            self.state = "running"
        return self

    def pause(self) -> "Layout":
        if self.state == "running":
            self.state = "paused"
        return self

    def set_config(self, config: Config) -> "Layout":
        self.config = config
        return self

    def step(self, still: float = 0.0) -> DataFrame:
        """One step if running; converged once no velocity exceeds ``still``. The places of the step before are taken away."""
        if self.state == "running":
            before, self.at = self.at, cut(step(self.at, self.edges, self.config))
            free(before)
            self.steps += 1
            if still and (self.at.agg(F.max(F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2))).first()[0] or 0.0) <= still:
                self.state = "converged"
        return self.at


def iterations(n: int) -> int:
    """Steps a frame, fewer for large graphs."""
    return 2 if n >= 5000 else 5 if n >= 1000 else 10


def camera(at: DataFrame) -> DataFrame:
    """One row: centroid and 2.5 times the largest distance from it."""
    c = F.broadcast(at.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))
    return at.join(c).agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), (2.5 * F.max(F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2))).alias("radius"))


def dense_ids(nodes: DataFrame) -> DataFrame:
    """id, index: a dense number in id order, counted within ranges and shifted by the ranges before, not in one task."""
    ranged = nodes.select("id").repartitionByRange("id").withColumn("part", F.spark_partition_id())
    ranged = cut(ranged)
    from pyspark.sql import Window

    # a row for each range
    sizes = ranged.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    return ranged.withColumn("k", inner).join(F.broadcast(sizes.select("part", "before")), "part").select("id", (F.col("k") + F.col("before")).alias("index"))


def colour(activation: Column) -> Column:
    """red, green, blue from blue (0) over yellow to red (1)."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), activation))
    return F.struct(F.round(255 * F.least(F.lit(1.0), 2 * t)).cast("int").alias("r"), F.round(255 * F.least(F.lit(1.0), 2 * (1 - t))).cast("int").alias("g"), F.round(255 * F.greatest(F.lit(0.0), 1 - 2 * t)).cast("int").alias("b"))
