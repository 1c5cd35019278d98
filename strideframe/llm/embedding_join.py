"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine ``threshold`` or more lie within a squared distance of 2 - 2 * threshold. A random rotation
(signs and Hadamard butterflies) spreads that distance evenly over the coordinates, which are split into blocks of
BLOCK_DIMS. A block's budget is its share of the squared distance: two vectors that exceed it in every block
exceed the whole, so any two that link keep within it in some block. Each block is range-joined by itself:
a tree of median cuts gives cells, a vector goes to its own cell and to all cells within the block's radius,
and every two cells that may hold partners meet in one task. Pairs within the budget are verified by their whole
vectors in double precision.

A pair counts in one block only, that of its least distance. Coordinates are rounded to whole multiples of 2 ** -20, whose
distances come out the same in every task, so no pair is counted twice or lost; the budgets have room for the rounding. No
task gives out pairs: it adds up each vector's links and names one vector of its local component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, trim
from .crowded_lists import merge
from .dart_minhash import components

THRESHOLD = 0.9
BLOCK_DIMS = 16
#: Vectors of a cell, and bytes of their coordinates: two cells meet in a task.
CELL_ROWS, CELL_BYTES = 1 << 14, 16_000_000
#: Cuts of the tree come from so many vectors at most (all vectors are placed by them); cells beyond are told apart by hash.
SAMPLE, SAMPLE_BYTES = 20_000, 64_000_000
SAMPLE_A_CELL = 8
CHUNK_PAIRS, PAIRS_AT_ONCE = 2_000_000, 50_000
#: Coordinates are whole multiples of this; SLACK is more than it moves a block's distance (BLOCK_DIMS ** 0.5 * STEP).
STEP, SLACK = 2.0**-20, 1e-5
ROTATIONS, SEED = 2, 20_011

ROWS = "row_id long, vec_id long, dim int, raw binary"
ROUTED = "block int, a long, b long, home long, rep long, weight long, raw binary"
FOUND = "rep long, links long, low long"


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length among a list column's values that are not null; nulls inside become NaN."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        values = pc.list_flatten(column.take(pa.array(rows))).to_numpy(zero_copy_only=False)
        yield rows, values.reshape(len(rows), int(length))


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        n = batch.num_rows
        dim, raw = np.zeros(n, np.int32), [None] * n
        for rows, values in _matrices(batch.column("embedding")):
            fine = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
            for i, v in zip(rows[fine], values[fine]):
                dim[i], raw[i] = len(v), v.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column("vec_id"), pa.array(dim), pa.array(raw, pa.binary())], names=["row_id", "vec_id", "dim", "raw"])
        row += n
    trim()


def units(values: np.ndarray) -> np.ndarray:
    """Rows divided by their length. Sums go column by column, so a row's result does not depend on its neighbours."""
    values = values.astype(np.float64)
    values /= np.abs(values).max(axis=1, keepdims=True)
    square = np.zeros(len(values))
    for j in range(values.shape[1]):
        square += values[:, j] ** 2
    return values / np.sqrt(square)[:, None]


def rotated(unit: np.ndarray) -> np.ndarray:
    """The rows turned by random signs and Hadamard butterflies, padded to a power of two, in whole multiples of STEP."""
    n, d = unit.shape
    size = 1 << (d - 1).bit_length()
    out = np.zeros((n, size))
    out[:, :d] = unit
    signs = np.random.default_rng(SEED).integers(0, 2, (ROTATIONS, size)) * 2.0 - 1
    for turn in signs:
        out *= turn
        h = 1
        while h < size:
            pair = out.reshape(n, size // (2 * h), 2, h)
            left, right = pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]
            pair[:, :, 0], pair[:, :, 1] = left, right
            h *= 2
        out /= np.sqrt(size)
    return np.rint(out / STEP)


def block_slices(dim: int) -> list[slice]:
    size = 1 << (dim - 1).bit_length()
    width = min(BLOCK_DIMS, size)
    return [slice(lo, lo + width) for lo in range(0, size, width)]


def radius(threshold: float, blocks: int) -> float:
    """How far two linked vectors may be apart, in steps, in the block of their least distance."""
    return (np.sqrt((2 - 2 * threshold + 1e-12) / blocks) + SLACK) / STEP


class Cells:
    """A block's cells: a complete binary tree of median cuts along the widest coordinate."""

    def __init__(self, points: np.ndarray, depth: int):
        width = points.shape[1]
        self.depth, self.axis, self.cut = depth, np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        low, high = np.full((2 ** (depth + 1) - 1, width), -np.inf), np.full((2 ** (depth + 1) - 1, width), np.inf)
        held = {0: points}
        for node in range(2**depth - 1):
            mine = held.pop(node)
            axis = int(mine.std(axis=0).argmax()) if len(mine) else 0
            cut = float(np.median(mine[:, axis])) if len(mine) else 0.0
            self.axis[node], self.cut[node] = axis, cut
            for side, child in enumerate((2 * node + 1, 2 * node + 2)):
                low[child], high[child] = low[node], high[node]
                (low if side else high)[child, axis] = cut
                held[child] = mine[(mine[:, axis] >= cut) == bool(side)]
        self.low, self.high = low[2**depth - 1 :], high[2**depth - 1 :]

    def home(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - (2**self.depth - 1)

    def near(self, points: np.ndarray, within: float) -> np.ndarray:
        """(points, cells): whether a cell lies within the radius."""
        out = np.empty((len(points), len(self.low)), bool)
        for c in range(len(self.low)):
            gap = np.maximum(np.maximum(self.low[c] - points, points - self.high[c]), 0)
            out[:, c] = (gap**2).sum(axis=1) <= within**2 * (1 + 1e-9)
        return out


def _values(raw: pa.ChunkedArray | pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(-1, dim)


def _route(cells: list[Cells], salts: int, dim: int, kind: str, threshold: float):
    slices = block_slices(dim)
    within = radius(threshold, len(slices))
    most = max(1, 500_000 // max(1, len(slices) * (1 << cells[0].depth) * salts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, most):
                batch = whole.slice(lo, most)
                turned = rotated(units(_values(batch.column("raw"), dim, kind)))
                rep = batch.column("rep").to_numpy()
                salt = (rep * 2654435761 >> 8) % salts
                for k, (tree, part) in enumerate(zip(cells, slices)):
                    points = turned[:, part]
                    home = tree.home(points) * salts + salt
                    row, leaf = np.nonzero(tree.near(points, within))
                    row, other = np.repeat(row, salts), (leaf[:, None] * salts + np.arange(salts)).reshape(-1)
                    mine = home[row]
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(row), k, np.int32)), pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other)), pa.array(mine),
                        batch.column("rep").take(at), batch.column("weight").take(at), batch.column("raw").take(at),
                    ], names=[x.split()[0] for x in ROUTED.split(", ")])
        trim()

    return run


def _squares(x: np.ndarray, y: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Squared distances of all rows of x and y. In float64 they are whole numbers below 2 ** 53, exact in any order;
    in float32, and in units of the vectors, they serve as a first sieve."""
    scale = 1.0 if kind is np.float64 else STEP
    x, y = x * scale, y * scale
    left = np.column_stack([x, (x**2).sum(axis=1), np.ones(len(x))]).astype(kind)
    right = np.column_stack([-2 * y, np.ones(len(y)), (y**2).sum(axis=1)]).astype(kind)
    return left @ right.T


def _gaps(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, part: slice) -> np.ndarray:
    """Exact squared distances of pairs of rows in a block."""
    out = np.zeros(len(i))
    for s in range(0, len(i), PAIRS_AT_ONCE):
        out[s : s + PAIRS_AT_ONCE] = ((left[i[s : s + PAIRS_AT_ONCE], part] - right[j[s : s + PAIRS_AT_ONCE], part]) ** 2).sum(axis=1)
    return out


def linked_pairs(unit: np.ndarray, turned: np.ndarray, x: np.ndarray, y: np.ndarray, slices: list[slice], k: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i of ``x``, j of ``y``; row numbers) that link and whose least distance is that of block ``k``."""
    within = radius(threshold, len(slices)) ** 2
    sieve = np.float32(within * STEP**2 + 1e-4)  # float32 errs by less
    step = max(1, CHUNK_PAIRS // max(1, len(y)))
    right = turned[y]
    for lo in range(0, len(x), step):
        rows = x[lo : lo + step]
        left = turned[rows]
        if x is y:  # the pairs above the diagonal
            near = _squares(left[:, slices[k]], right[lo:, slices[k]], np.float32) <= sieve
            i, j = np.divmod(np.flatnonzero(near), len(y) - lo)
            i, j = i[j > i], j[j > i] + lo
        else:
            near = _squares(left[:, slices[k]], right[:, slices[k]], np.float32) <= sieve
            i, j = np.divmod(np.flatnonzero(near), len(y))
        if not len(i):
            continue
        if len(i) > near.size // 20:  # many pairs: whole matrices are less work
            cosine = (unit[rows] @ unit[y].T)[i, j]
            close = np.flatnonzero(np.abs(cosine - threshold) < 1e-9)
            cosine[close] = _dots(unit, rows[i[close]], y[j[close]])
            gap = lambda part: _squares(left[:, part], right[:, part])[i, j]
        else:
            cosine = _dots(unit, rows[i], y[j])
            gap = lambda part: _gaps(left, right, i, j, part)
        keep = cosine >= threshold
        i, j = i[keep], j[keep]
        own = gap(slices[k])
        least = own <= within
        for b, part in enumerate(slices):
            if b != k and least.any():
                least &= gap(part) > own if b < k else gap(part) >= own
        yield rows[i[least]], y[j[least]]


def _dots(unit: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(len(i))
    for s in range(0, len(i), PAIRS_AT_ONCE):
        out[s : s + PAIRS_AT_ONCE] = np.einsum("ij,ij->i", unit[i[s : s + PAIRS_AT_ONCE]], unit[j[s : s + PAIRS_AT_ONCE]])
    return out


def _links(dim: int, kind: str, threshold: float):
    slices = block_slices(dim)

    def run(table: pa.Table) -> pa.Table:
        k, a, b = (table.column(c)[0].as_py() for c in ("block", "a", "b"))
        home, rep, weight = (table.column(c).to_numpy() for c in ("home", "rep", "weight"))
        x, y = np.flatnonzero(home == a), np.flatnonzero(home == b)
        links, parent = np.zeros(len(home), np.int64), np.arange(len(home))
        if len(x) and len(y):
            unit = units(_values(table.column("raw"), dim, kind))
            turned = rotated(unit)
            for i, j in linked_pairs(unit, turned, x, x if a == b else y, slices, k, threshold):
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                parent = merge(parent, i, j)
        some = np.flatnonzero(links)
        return pa.table([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[parent[some]])], names=["rep", "links", "low"])

    return run


def _found(reps: DataFrame, dim: int, kind: str, threshold: float, cell_rows: int) -> DataFrame:
    """rep, links, low of the vectors of one length, several rows for a vector."""
    mine = reps.filter(F.col("dim") == dim)
    room = max(2, min(cell_rows, CELL_BYTES // (8 * dim)))
    wanted = -(-mine.count() // room)
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)) // SAMPLE_A_CELL)
    depth = min((wanted - 1).bit_length(), most.bit_length() - 1)
    rows = mine.select("raw").orderBy(F.xxhash64("raw")).limit(most * SAMPLE_A_CELL).collect() if depth else []
    sample = rotated(units(_values(pa.array([bytes(r["raw"]) for r in rows], pa.binary()), dim, kind))) if rows else np.zeros((0, 1 << (dim - 1).bit_length()))
    cells = [Cells(sample[:, part], depth) for part in block_slices(dim)]
    routed = mine.select("rep", "weight", "raw").mapInArrow(_route(cells, -(-wanted // 2**depth), dim, kind, threshold), ROUTED)
    return routed.groupBy("block", "a", "b").applyInArrow(_links(dim, kind, threshold), FOUND)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Two vectors link if their cosine, in double precision, is ``threshold`` or more. n_links counts the other rows that link
    with a row, copies of its own vector included; component_id is the least vec_id that links lead to, its own included. Vectors
    that are null, empty, zero, or hold null or infinite values link with nothing, and so do vectors of different lengths.
    Repeated ids are rows of their own; a null id is never the least, unless nothing else is there, and such a row is kept. An empty
    table gives an empty result; other columns are ignored. Copies stand as one vector. ``cell_rows`` changes the work only. Runs
    Spark jobs when called.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    given = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<float>" if single else "array<double>").alias("embedding"))
    rows = staged(given.mapInArrow(_prepare, ROWS), "vectors")
    reps = rows.filter("dim > 0").groupBy("dim", "raw").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.min("row_id").alias("rep"))
    reps = staged(reps, "distinct-vectors")
    found = None
    for r in reps.select("dim").distinct().orderBy("dim").collect():  # the lengths of vectors: one in a table of one model
        part = _found(reps, r["dim"], kind, threshold, cell_rows)
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], FOUND)
    found = staged(found, "vector-links")
    roots = staged(components(found.select(F.col("rep").alias("a"), F.col("low").alias("b"))), "roots")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    marked = staged(
        reps.join(links, "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .select("dim", "raw", "low", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")),
        "marked-vectors",
    )
    lows = marked.groupBy("root").agg(F.min("low").alias("component_id"))
    known = marked.join(lows, "root").select(F.col("dim").alias("k_dim"), F.col("raw").alias("k_raw"), "n_links", "component_id")
    discard(reps, found)
    out = rows.join(known, (F.col("dim") == F.col("k_dim")) & (F.col("raw") == F.col("k_raw")), "left")
    component = F.when(F.col("dim") > 0, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
