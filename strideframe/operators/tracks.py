"""Depth along the tracks of all joints of long runs: outliers of hands, gaps and medians, frame by frame in arrays.

A frame is one row with arrays over its joints, so a run moves as often as it has frames, not as its joints do. Missing values are
NULL outside and NaN with a mask inside; NaN itself counts as a value above all others, as in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.operators import scans

VALUES = ("px", "py", "lik", "z")
#: Frames of a block, and frames whose windows lie side by side.
BLOCK, CHUNK = 8_192, 1_024


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """Lists of equal length as rows, NaN where a value is missing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _missing(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().is_null().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(values: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    rows, n = values.shape
    flat = pa.array(values.ravel(), mask=None if missing is None else missing.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * n, pa.int32()), flat)


def middle(values: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Medians along the last axis of the values that are there; NaN if none is."""
    n = there.sum(axis=-1, keepdims=True)
    in_order = np.sort(np.where(there, values, np.nan), axis=-1)
    a = np.take_along_axis(in_order, np.maximum(n - 1, 0) // 2, axis=-1)[..., 0]
    b = np.take_along_axis(in_order, np.minimum(n // 2, values.shape[-1] - 1), axis=-1)[..., 0]
    return np.where(a == b, a, 0.5 * a + 0.5 * b)


def outliers(px: np.ndarray, py: np.ndarray, lik: np.ndarray, z: np.ndarray, missing: dict[str, np.ndarray], hands: list[list[int]], centre: tuple[float, float], focal: float, radius: float, floor: float) -> np.ndarray:
    """``lifting.hand_outliers`` for frames (rows, joints)."""
    out = np.zeros(z.shape, bool)
    for joints in hands:
        gone = {k: v[:, joints] for k, v in missing.items()}
        depth = z[:, joints]
        points = [(px[:, joints] - centre[0]) * depth / focal, (py[:, joints] - centre[1]) * depth / focal, depth]
        known = [~(gone["px"] | gone["z"]), ~(gone["py"] | gone["z"]), ~gone["z"]]
        valid = known[2] & ~gone["lik"] & ~(lik[:, joints] < floor)
        away = np.zeros(depth.shape)
        for p, k in zip(points, known):
            away += (p - middle(p, valid & k)[:, None]) ** 2
        flag = valid & known[0] & known[1] & (valid.sum(axis=1) >= 2)[:, None] & ~(np.sqrt(away) <= radius)
        for a in (0, 1):  # no median, no distance
            flag &= (valid & known[a]).any(axis=1)[:, None]
        flag[:, 0] = False
        out[:, joints] = flag
    return out


def flagged(frames: DataFrame, hands: list[list[int]], centre: tuple[float, float], focal: float, radius: float, floor: float) -> DataFrame:
    """run, frame_index, the arrays VALUES and ``good``: depth that is there and no outlier. ``frames``: run, frame_index and VALUES."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = {c: _matrix(batch[c], batch.num_rows) for c in VALUES}
                missing = {c: _missing(batch[c], batch.num_rows) for c in VALUES}
                bad = outliers(*(values[c] for c in VALUES), missing, hands, centre, focal, radius, floor)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("run", "frame_index", *VALUES)), _lists(bad)], names=["run", "frame_index", *VALUES, "bad"])

    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("run", "frame_index"))
    return frames.select("run", "frame_index", *VALUES).mapInArrow(mark, f"{kinds}, {', '.join(f'{c} array<double>' for c in VALUES)}, bad array<boolean>")


def _good(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, depth, missing, bad, good of a block's frames in order."""
    rows = block.num_rows
    z, gone, bad = _matrix(block["z"], rows), _missing(block["z"], rows), _matrix(block["bad"], rows) > 0
    return block["frame_index"].to_numpy(), z, gone, bad, ~gone & ~bad


def _ends(block: pa.Table) -> pa.Table:
    """A row a joint: the first and the last good depth of a block."""
    place, z, _, _, good = _good(block.sort_by("frame_index"))
    n, joints = good.shape
    first, last, all_of = good.argmax(axis=0), n - 1 - good[::-1].argmax(axis=0), np.arange(joints)
    none = ~good.any(axis=0)
    end = lambda i: pa.StructArray.from_arrays([pa.array(place[i].astype(np.int64)), pa.array(z[i, all_of])], names=["i", "v"], mask=pa.array(none))
    same = lambda c: block[c].combine_chunks().take(pa.array(np.zeros(joints, int)))
    return pa.table({"run": same("run"), "_block": same("_block"), "joint": pa.array(all_of.astype(np.int32)), "first": end(first), "last": end(last)})


def _fill(block: pa.Table, carried: pa.Table) -> pa.Table:
    """``scans.fill_gaps`` for all joints of a block; what lies beyond it comes in ``carried``, a row a joint."""
    if not block.num_rows:
        return block.drop_columns(["bad"])
    block, carried = block.sort_by("frame_index"), carried.sort_by("joint")
    place, z, gone, bad, good = _good(block)
    n, joints = good.shape
    sides = []
    for name in ("last", "first"):
        column = carried[name].combine_chunks()
        there = column.is_valid().to_numpy(zero_copy_only=False)
        at, value = (column.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("i", "v"))
        sides.append((np.where(there, at, np.nan), value, there))
    rows, all_of = np.arange(n)[:, None], np.arange(joints)
    # of each row: the last good row before it and the first after it, or what was carried
    before = np.vstack([np.full((1, joints), -1), np.maximum.accumulate(np.where(good, rows, -1), axis=0)[:-1]])
    after = np.vstack([np.minimum.accumulate(np.where(good, rows, n)[::-1], axis=0)[::-1][1:], np.full((1, joints), n)])
    ends = []
    for row, inside, (at, value, there) in ((before, before >= 0, sides[0]), (after, after < n, sides[1])):
        row = np.clip(row, 0, n - 1)
        ends.append((np.where(inside, place[row], at), np.where(inside, z[row, all_of], value), inside | there))
    (ai, av, a), (bi, bv, b) = ends
    with np.errstate(invalid="ignore", divide="ignore"):
        line = av + (bv - av) * (place[:, None] - ai) / (bi - ai)
    filled = np.where(bad, line, z)
    return pa.table({**{c: block[c] for c in block.column_names if c not in ("z", "bad")}, "z": _lists(filled, np.where(bad, ~(a & b), gone))})


def _smooth(block: pa.Table, before: int, after: int, centre: tuple[float, float], focal: float) -> pa.Table:
    """Own frames of a block with depth as the median of its window, x and y by it."""
    block = block.sort_by("frame_index")
    own = block["_own"].to_numpy(zero_copy_only=False)
    n = block.num_rows
    if not own.any():  # beyond the end of the run
        none = block.slice(0, 0)
        return pa.table({"run": none["run"], "frame_index": none["frame_index"], **{c: none["z"] for c in ("x", "y", "z", "lik")}})
    z, gone = _matrix(block["z"], n), _missing(block["z"], n)
    pad = ((before, after), (0, 0))
    z_around, there = np.pad(z, pad), np.pad(~gone, pad)
    out = np.empty(z.shape)
    for lo in range(0, n, CHUNK):
        hi = min(n, lo + CHUNK)
        windows = [np.lib.stride_tricks.sliding_window_view(x[lo : hi + before + after], before + after + 1, axis=0) for x in (z_around, there)]
        out[lo:hi] = middle(*windows)
    out, gone = out[own], gone[own]
    mine = block.filter(pa.array(own))
    lists = {"lik": mine["lik"], "z": _lists(out, gone)}
    for name, c in (("x", centre[0]), ("y", centre[1])):
        p, lost = _matrix(mine[f"p{name}"], len(out)), _missing(mine[f"p{name}"], len(out))
        lists[name] = _lists((p - c) * out / focal, lost | gone)
    return pa.table({"run": mine["run"], "frame_index": mine["frame_index"], **{c: lists[c] for c in ("x", "y", "z", "lik")}})


def smoothed(frames: DataFrame, centre: tuple[float, float], focal: float, window: int, block: int = BLOCK) -> DataFrame:
    """run, frame_index and the arrays x, y, z, lik: depth of ``flagged`` frames, outliers filled between good neighbours any number of frames
    away, then as the median of ``window`` rows; x and y follow from it."""
    kinds = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in ("run", "frame_index"))
    run = frames.schema["run"].dataType.simpleString()
    rows = scans.blocked(frames, "run", block=block).persist()  # read by the blocks' ends and by the rows
    end = "struct<i:long,v:double>"
    ends = rows.select("run", "_block", "frame_index", "z", "bad").groupBy("run", "_block").applyInArrow(_ends, f"run {run}, _block long, joint int, first {end}, last {end}")
    ends = scans.carried_ends(ends.withColumn("_track", F.struct("run", "joint")), "_track", block)
    ends = ends.select("_track.run", "_block", "_track.joint", "last", "first")
    arrays = lambda names: ", ".join(f"{c} array<double>" for c in names)
    keys = ["run", "_block"]
    filled = rows.groupBy(*keys).cogroup(ends.groupBy(*keys)).applyInArrow(_fill, f"{kinds}, {arrays(('px', 'py', 'lik'))}, _block long, z array<double>")
    before, after = window // 2, window - window // 2 - 1
    around = scans.with_halo(filled.drop("_block"), before, after, block=block)
    return around.groupBy(*keys).applyInArrow(lambda t: _smooth(t, before, after, centre, focal), f"{kinds}, {arrays(('x', 'y', 'z', 'lik'))}")
