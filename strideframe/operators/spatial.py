"""Exact nearest neighbours by an index of cells.

The first axis is cut into strips of about equally many points, each strip into cells of about CELL_POINTS along the second one;
a cell is known by its number of points and the box that holds them (on all axes). For a query, the cells around it
bound the distance of its k-th neighbour: k points lie no farther than the far corners of the boxes that hold them. Only cells
whose boxes come within that distance are read. A query meets a few cells, whatever the table holds, and the table of cells
is of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.expr import finite

CELL_POINTS = 512
#: Strips, and cells of a strip, at most: the table of cells has MOST_STRIPS ** 2 rows. Beyond, cells hold more points.
MOST_STRIPS = 512
#: Points of a cell, in units of CELL_POINTS, from which equal places are cut down to the k that can be among the nearest.
CROWDED = 8


class CellIndex:
    """Edges of strips and cells, and what the cells hold."""

    def __init__(self, strips: np.ndarray, cells: list[np.ndarray]):
        self.strips, self.cells = strips, cells
        self.first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cells])])
        self.n = np.zeros(self.first[-1], np.int64)
        self.low = self.high = np.zeros((0, 0))

    def place(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        strip = np.searchsorted(self.strips, x, side="right")
        out = np.zeros(len(x), np.int64)
        for s in np.unique(strip):
            mine = np.flatnonzero(strip == s)
            out[mine] = self.first[s] + np.searchsorted(self.cells[s], y[mine], side="right")
        return out

    def fill(self, cell: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.low, self.high = np.full((len(self.n), low.shape[1]), np.inf), np.full((len(self.n), low.shape[1]), -np.inf)
        self.n[cell], self.low[cell], self.high[cell] = n, low, high

    def bound(self, q: np.ndarray, k: int) -> float:
        """A distance within which ``k`` points lie, or all of them."""
        s, reach = int(np.searchsorted(self.strips, q[0], side="right")), 1
        while True:
            lo, hi = max(0, s - reach), min(len(self.cells), s + reach + 1)
            part = np.arange(self.first[lo], self.first[hi])
            part = part[self.n[part] > 0]
            if self.n[part].sum() >= k or hi - lo == len(self.cells):
                far = np.sqrt((np.maximum(np.abs(q - self.low[part]), np.abs(q - self.high[part])) ** 2).sum(axis=1))
                order = np.argsort(far)
                at = int(np.searchsorted(np.cumsum(self.n[part][order]), k))
                return float(far[order[min(at, len(order) - 1)]]) if len(order) else 0.0
            reach *= 2

    def near(self, q: np.ndarray, k: int) -> np.ndarray:
        """The cells that can hold one of the ``k`` nearest points."""
        within = self.bound(q, k) * (1 + 1e-9)
        lo, hi = (int(np.searchsorted(self.strips, q[0] + d, side=side)) for d, side in ((-within, "left"), (within, "right")))
        part = np.arange(self.first[lo], self.first[min(hi + 1, len(self.cells))])
        part = part[self.n[part] > 0]
        gap = np.maximum(np.maximum(self.low[part] - q, q - self.high[part]), 0)
        return part[np.sqrt((gap**2).sum(axis=1)) <= within]


def _with(df: DataFrame, make, name: str) -> DataFrame:
    """The rows with a long column ``name``: ``make`` takes a batch, and gives rows to take and their values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, value = make(batch)
            taken = batch.take(pa.array(rows)) if rows is not None else batch
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(value, pa.int64())], names=[*batch.schema.names, name])

    return df.mapInArrow(run, df.withColumn(name, F.lit(0).cast("long")).schema)


def _axis(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)


def _edges(values: list[float] | None) -> np.ndarray:
    return np.unique(np.array(values or [], np.float64))


def build_index(points: DataFrame, axes: list[str], cell_points: int = CELL_POINTS) -> tuple[CellIndex, DataFrame]:
    """The index of ``points`` (finite on all axes), and the points with their ``_cell``."""
    first, second = axes[0], axes[1] if len(axes) > 1 else axes[0]
    n = points.count()
    strips = int(min(MOST_STRIPS, max(1, round((n / cell_points) ** (0.5 if len(axes) > 1 else 1)))))
    shares = [i / strips for i in range(1, strips)]
    accuracy = 10_000 + 20 * strips
    cut = lambda c: F.percentile_approx(c, F.lit(shares), accuracy) if shares else F.lit(None).cast("array<double>")
    edges = _edges(points.agg(cut(F.col(first)).alias("e")).first()["e"])
    cells = [np.zeros(0)] * (len(edges) + 1)
    if len(axes) > 1 and shares:
        narrow = points.select(F.col(first).alias("x"), F.col(second).alias("y"))
        in_strip = _with(narrow, lambda b: (None, np.searchsorted(edges, _axis(b, "x"), side="right")), "strip")
        for r in in_strip.groupBy("strip").agg(cut(F.col("y")).alias("e")).collect():  # MOST_STRIPS rows at most
            cells[r["strip"]] = _edges(r["e"])
    index = CellIndex(edges, cells)
    placed = _with(points, lambda b: (None, index.place(_axis(b, first), _axis(b, second))), "_cell")
    boxes = placed.groupBy("_cell").agg(F.count("*").alias("n"), *[f(a).alias(f"{f.__name__}_{i}") for f in (F.min, F.max) for i, a in enumerate(axes)]).toArrow()
    column = lambda c: boxes.column(c).to_numpy().astype(np.float64)
    low, high = (np.column_stack([column(f"{f}_{i}") for i in range(len(axes))]) if len(boxes) else np.zeros((0, len(axes))) for f in ("min", "max"))
    filled = CellIndex(edges, cells)
    filled.fill(boxes.column("_cell").to_numpy(), boxes.column("n").to_numpy(), low, high)
    return filled, placed


def candidate_pairs(queries: DataFrame, points: DataFrame, axes: list[str], k: int, ties: list[str], cell_points: int = CELL_POINTS) -> DataFrame:
    """Each query (query_id and its coordinates as ``q_<axis>``) with the points of the cells that can hold one of its ``k`` nearest."""
    there = F.lit(True)
    for a in axes:
        there = there & finite(F.col(a)).isNotNull()
    double = lambda df: df.select(*[F.col(c).cast("double").alias(c) if c in axes else F.col(c) for c in df.columns]).filter(there)
    index, placed = build_index(double(points), axes, cell_points)
    crowded = np.flatnonzero(index.n > CROWDED * cell_points).tolist()
    if crowded:  # of points at one place, the first k by their order stand for all
        full = F.col("_cell").isin(crowded)
        place = F.row_number().over(Window.partitionBy("_cell", *axes).orderBy(*ties))
        placed = placed.filter(~full).union(placed.filter(full).withColumn("_place", place).filter(F.col("_place") <= k).drop("_place"))
    named = double(queries.select("query_id", *axes)).select("query_id", *[F.col(a).alias(f"q_{a}") for a in axes])

    def reach(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        at = np.column_stack([_axis(batch, f"q_{a}") for a in axes])
        found = [index.near(q, k) for q in at]
        return np.repeat(np.arange(len(at)), [len(f) for f in found]), np.concatenate([*found, np.zeros(0, np.int64)])

    return _with(named, reach, "_cell").join(placed, "_cell").drop("_cell")


def nearest(queries: DataFrame, points: DataFrame, axes: list[str], k: int, ties: list[str], cell_points: int = CELL_POINTS) -> DataFrame:
    """The ``k`` nearest ``points`` of each query (query_id and ``axes``): query_id, the columns of ``points``, distance and rank.

    Distances are Euclidean; equal ones stand by ``ties``. Queries and points without a finite value on every axis are left
    out. Repeated points are points of their own; a query_id stands for one query. Runs Spark jobs when called: the index.
    """
    gap = F.sqrt(sum(((F.col(f"q_{a}") - F.col(a)) ** 2 for a in axes[1:]), (F.col(f"q_{axes[0]}") - F.col(axes[0])) ** 2))
    pairs = candidate_pairs(queries, points, axes, k, ties, cell_points).withColumn("distance", gap)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", *ties))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).drop(*[f"q_{a}" for a in axes])
