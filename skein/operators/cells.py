"""A cell system with a user's own update function: neighbours keep their repeats, histories their last states."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import ship
from .tables import cut, free


class CellSystem:
    """update gets a frame of (id, activation, n, total, top) — a cell and its neighbours' count, sum and largest activation,
    parallel edges counted each — and gives the new activations. All cells read the old state."""

    def __init__(self, graph: Graph, state: DataFrame, update: Callable[[pd.DataFrame], pd.Series], window: int = 8):
        self.graph, self.state, self.update, self.window, self.history = graph, state.select("id", "activation"), update, window, []

    def tick(self) -> DataFrame:
        update = self.update
        ship(self.state.sparkSession)

        def run(batches):
            for b in batches:
                yield b[["id"]].assign(activation=update(b).clip(0.0, 1.0))

        peers = self.state.select(F.col("id").alias("peer"), F.col("activation").alias("a"))
        near = self.graph.both_ways().join(peers, "peer").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("total"), F.max("a").alias("top"))
        seen = self.state.join(near, "id", "left").fillna({"n": 0, "total": 0.0, "top": 0.0})
        kept = [*self.history, self.state]
        self.history = kept[-self.window :]
        self.state = cut(seen.select("id", "activation", "n", "total", "top").mapInPandas(run, "id long, activation double"))
        free(*kept[: -self.window])
        return self.state

    def run(self, ticks: int) -> DataFrame:
        for _ in range(ticks):
            self.tick()
        return self.state
