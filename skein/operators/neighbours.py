"""The k nearest neighbours of every vector: an exact join over Voronoi cells, kept small by the triangle inequality.

On unit vectors cosine falls as Euclidean distance grows, and distances obey the triangle inequality. Each vector lies in the cell
of its nearest pivot. A first round finds neighbours within the cell, which gives each vector a distance that its k-th neighbour
does not exceed; a second round sends it only to those other cells that may hold something as near, and there compares it only
with members whose own distance to the pivot allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .tables import cut, free

#: Pivots at most: they and their cells' radii go to all tasks, the numbers of pivots being a bounded sample.
MOST_PIVOTS = 1024
#: Members of a piece of a cell and vectors asking in a group, on average: what one task holds at once. Cells are about as large, so
#: that a vector goes to n / piece cells at most, whether or not bounds rule any out.
PIECE = 4096
#: Pieces grow with the table, to so many times PIECE, so that vectors are sent PIECES times each until then.
PIECES, WIDEST = 32, 8
#: Vectors that are compared, or sent on, at once.
ROWS = 128
#: Rounding of distances, which are roots of differences and so are off by up to 1e-8: bounds are wider by this.
SLACK = 1e-7

ROW = "id long, cell int, far double, dim int, unit binary"


def piece_of(n: int) -> int:
    """Vectors of a piece, for ``n`` in all."""
    return min(WIDEST * PIECE, max(PIECE, -(-n // PIECES)))


def _units(frame: pd.DataFrame, width: int) -> np.ndarray:
    """The vectors of ``unit`` one below the other."""
    return np.frombuffer(b"".join(frame["unit"]), "<f8").reshape(len(frame), width)


def _placed(frames: Iterator[pd.DataFrame], pivots: np.ndarray) -> Iterator[pd.DataFrame]:
    """Unit vectors, filled up to one width with zeros, with their nearest pivot and the distance to it."""
    for frame in frames:
        unit = np.zeros((len(frame), pivots.shape[1]))
        for row, v in zip(unit, frame["embedding"]):
            row[: len(v)] = np.asarray(v, float) / np.sqrt(np.sum(np.square(np.asarray(v, float))))
        near = _distances(unit, pivots)
        cell = near.argmin(axis=1) if len(frame) else np.zeros(0, int)
        yield pd.DataFrame({"id": frame["id"], "cell": cell.astype("int32"), "far": near[np.arange(len(frame)), cell], "dim": frame["embedding"].map(len).astype("int32"), "unit": [u.tobytes() for u in unit]})


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _best(asking: pd.DataFrame, members: pd.DataFrame, width: int, k: int, least: float) -> pd.DataFrame:
    """The k nearest members of each vector asking, over ``least`` and at most ``reach`` away; copies by id, itself left out."""
    empty = pd.DataFrame({"id": np.zeros(0, "int64"), "peer": np.zeros(0, "int64"), "score": np.zeros(0)})
    if asking.empty or members.empty:
        return empty
    held, far, peers, dims = _units(members, width), members["far"].to_numpy(), members["id"].to_numpy(), members["dim"].to_numpy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(asking), ROWS):
        part = asking.iloc[start : start + ROWS]
        ids, apart, reach = part["id"].to_numpy(), part["apart"].to_numpy()[:, None], part["reach"].to_numpy()[:, None] + SLACK
        scores = _units(part, width) @ held.T
        # A member at another distance from the pivot than this is farther away than the k-th neighbour so far.
        fits = (scores > least) & (np.abs(far - apart) <= reach) & (peers != ids[:, None]) & (dims == part["dim"].to_numpy()[:, None])
        ranked = np.where(fits, np.round(scores, 12), -np.inf)
        if k < ranked.shape[1]:
            fits &= ranked >= np.partition(ranked, -k, axis=1)[:, [-k]]
        at, of = np.nonzero(fits)
        # Where more than k are left the last of them tie: the least ids stay.
        order = np.lexsort((peers[of], -ranked[at, of], at))
        at, of = at[order], of[order]
        first = np.searchsorted(at, at)
        keep = np.arange(len(at)) - first < k
        found.append((ids[at[keep]], peers[of[keep]], scores[at[keep], of[keep]]))
    return pd.DataFrame({"id": np.concatenate([f[0] for f in found]), "peer": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})


def all_neighbours(index: DataFrame, k: int = 5, least: float = 0.1) -> DataFrame:
    """id, peer, score, label: for each vector of ``index`` (id, embedding) the ``k`` others most similar by cosine, if over
    ``least``; equal scores (to twelve places) by id.

    Null and zero vectors and those with null or not finite components have no neighbours and are none; vectors of different
    length aren't compared. ids are distinct. Copies of one vector are joined through their k + 1 least ids, so that a vector
    that a third of the rows share costs what any other does.
    """
    spark = index.sparkSession
    ship(spark)
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 1e150))
    usable = index.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where(fine & F.exists("embedding", lambda x: F.abs(x) > 1e-150))
    key = F.xxhash64("embedding")
    named = cut(usable.withColumn("copy", key))
    ranked = named.withColumn("n", F.row_number().over(Window.partitionBy("copy", "embedding").orderBy("id"))).where(F.col("n") <= k + 1)
    few = cut(ranked.select("id", "copy", "embedding", "n"))
    distinct = few.where("n = 1").select("id", "embedding")
    n, width = distinct.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    empty = "id long, peer long, score double"
    if not n:
        free(named, few)
        return spark.createDataFrame([], empty + ", label string")
    piece = piece_of(n)
    wanted = min(MOST_PIVOTS, -(-n // piece))
    chosen = [r[0] for r in distinct.orderBy(F.xxhash64(F.col("id") + 1), "id").limit(wanted).select("embedding").collect()]
    pivots = np.zeros((len(chosen), width))
    for row, v in zip(pivots, chosen):
        row[: len(v)] = np.asarray(v) / np.sqrt(np.sum(np.square(v)))
    members = cut(distinct.mapInPandas(lambda frames: _placed(frames, pivots), ROW))
    cells = {r.cell: (r.radius, r.n) for r in members.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    widest = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def joined(asking: DataFrame, numbers: dict[int, int]) -> DataFrame:
        """Every row of ``asking`` (to: the cell it goes to, apart: its distance to that pivot, reach) with each piece of the cell;
        ``numbers``: how many rows go to a cell. Neither a piece nor a group of those that ask grows with the cell."""
        sizes = F.broadcast(spark.createDataFrame([(c, -(-cells[c][1] // piece), -(-asks // piece)) for c, asks in numbers.items()], "to int, pieces int, parts int"))
        asks = asking.join(sizes, "to").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).withColumn("part", F.pmod(F.xxhash64("id", F.lit("ask")), F.col("parts").cast("long")).cast("int"))
        asks = asks.toDF(*asks.columns)
        held = members.withColumnRenamed("cell", "to").join(sizes, "to").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces").cast("long")).cast("int"))
        held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        held = held.toDF(*held.columns)
        keys = ["to", "piece", "part"]
        run = lambda left, right: _best(left, right, width, k, least)
        return asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, empty)

    by_score = Window.partitionBy("id").orderBy(F.desc(F.round("score", 12)), "peer")
    best = lambda df: df.withColumn("__n", F.row_number().over(by_score)).where(F.col("__n") <= k).drop("__n")
    own = members.select("id", "dim", "unit", F.col("cell").alias("to"), F.col("far").alias("apart"), F.lit(widest).alias("reach"))
    first = cut(best(joined(own, {c: m for c, (_, m) in cells.items()})))
    # Once a vector has k neighbours, nothing farther than the last of them matters.
    kth = first.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    reach = F.when(F.col("least").isNull(), F.lit(widest)).otherwise(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least"))))
    asking = members.join(kth, "id", "left").select("id", "cell", "dim", "unit", reach.alias("reach"))
    between = _distances(pivots, pivots)

    numbers = np.array(sorted(cells))
    radius = np.array([cells[c][0] for c in numbers])

    def reached(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Some vectors, and by row and cell which other cells their bounds reach: their ball, and their side of the plane between
        the pivots."""
        for whole in frames:
            for start in range(0, len(whole), ROWS):
                frame = whole.iloc[start : start + ROWS]
                to_pivots, home = _distances(_units(frame, width), pivots), frame["cell"].to_numpy()
                away, apart = to_pivots[:, numbers], between[home][:, numbers]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (away**2 - to_pivots[np.arange(len(frame)), home][:, None] ** 2) / (2 * apart)
                plane = np.where(apart > 1e-6, plane, -np.inf)
                row, cell = np.nonzero((np.maximum(away - radius, plane) <= frame["reach"].to_numpy()[:, None] + SLACK) & (numbers != home[:, None]))
                yield frame, row, cell, away

    def sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, row, cell, away in reached(frames):
            on = frame.iloc[row]
            yield pd.DataFrame({"id": on["id"].to_numpy(), "dim": on["dim"].to_numpy(), "unit": on["unit"].to_numpy(), "to": numbers[cell].astype("int32"), "apart": away[row, cell], "reach": on["reach"].to_numpy()})

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, cell, _ in reached(frames):
            to, asks = np.unique(numbers[cell], return_counts=True)
            yield pd.DataFrame({"to": to.astype("int32"), "asks": asks.astype("int64")})

    # Which cells are asked how often is counted first: what is sent is not written for it.
    wide = {r.to: r.asks for r in asking.mapInPandas(counted, "to int, asks long").groupBy("to").agg(F.sum("asks").alias("asks")).collect()}
    further = asking.mapInPandas(sent, "id long, dim int, unit binary, to int, apart double, reach double")
    # Through representatives: one vector of each kind asks, and its answers name one vector of each kind.
    pairs = cut(best(first.unionByName(joined(further, wide)))) if wide else first
    by_rep = few.groupBy("copy", "embedding").agg(F.min("id").alias("rep"))
    kinds = few.join(by_rep, ["copy", "embedding"]).select("id", "rep")
    askers = named.join(by_rep, ["copy", "embedding"]).select("id", "rep")
    through = pairs.select(F.col("id").alias("rep"), F.col("peer").alias("to"), "score").unionByName(by_rep.select("rep", F.col("rep").alias("to"), F.lit(1.0).alias("score")))
    offered = through.join(kinds.select(F.col("rep").alias("to"), F.col("id").alias("peer")), "to").select("rep", "peer", "score")
    listed = offered.withColumn("__n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc(F.round("score", 12)), "peer"))).where(F.col("__n") <= k + 1).drop("__n")
    out = best(askers.join(listed, "rep").where("id <> peer").select("id", "peer", "score"))
    return out.withColumn("label", F.format_string("semantic(%.2f)", "score"))
