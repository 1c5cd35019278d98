"""From pixels and depth to metric poses, and skeletons of fixed bone lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.expr import finite
from strideframe.operators import quantiles

SHOULDER_WIDTH_M = 0.40
OUTLIER_RADIUS_M, OUTLIER_LIKELIHOOD = 0.15, 0.05


def bilinear(depth: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The depth at a sub-pixel place of a row-major raster; places outside are moved to the border."""
    cx = F.greatest(F.lit(0.0), F.least(x, (w - 1).cast("double")))
    cy = F.greatest(F.lit(0.0), F.least(y, (h - 1).cast("double")))
    x0, y0 = F.floor(cx).cast("int"), F.floor(cy).cast("int")
    x1, y1 = F.least(x0 + 1, w - 1), F.least(y0 + 1, h - 1)
    fx, fy = cx - x0, cy - y0
    at = lambda yy, xx: F.get(depth, yy * w + xx)
    top = at(y0, x0) * (1 - fx) + at(y0, x1) * fx
    low = at(y1, x0) * (1 - fx) + at(y1, x1) * fx
    return F.when(x.isNotNull() & y.isNotNull(), top * (1 - fy) + low * fy)


def calibration_samples(pairs: DataFrame, min_likelihood: float = 0.5) -> DataFrame:
    """Pixel shoulder length times mean depth, of frames where both shoulders are confident.
    Columns: run, lx, ly, llik, rx, ry, rlik, dl, dr."""
    length = F.sqrt((F.col("rx") - F.col("lx")) ** 2 + (F.col("ry") - F.col("ly")) ** 2)
    ok = (F.col("llik") >= min_likelihood) & (F.col("rlik") >= min_likelihood) & (length >= 1e-3) & (finite(F.col("dl")) > 0) & (finite(F.col("dr")) > 0)
    return pairs.filter(ok).select("run", (length * (F.col("dl") + F.col("dr")) / 2).alias("sample"))


def depth_scale(samples: DataFrame, runs: DataFrame, fx: Column, shoulder_width_m: float = SHOULDER_WIDTH_M, long_runs: bool = False) -> DataFrame:
    """run, n_samples, depth_scale: one factor a run; 1 where nothing could be measured. ``long_runs``: see ``bone_lengths``."""
    if long_runs:
        found = quantiles.grouped_median(samples, ["run"], "sample", "_m").withColumnRenamed("n", "n_samples")
    else:
        found = samples.groupBy("run").agg(F.count("*").alias("n_samples"), F.median("sample").alias("_m"))
    return runs.join(found, "run", "left").select(
        "run", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), F.coalesce(F.try_divide(F.lit(shoulder_width_m) * fx, F.col("_m")), F.lit(1.0)).alias("depth_scale")
    )


def backproject(px: Column, py: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    return F.struct(((px - cx) * z / fx).alias("x"), ((py - cy) * z / fy).alias("y"), z.alias("z"))


def metric_depth(depth: Column, fx: Column, fy: Column) -> Column:
    """Depth of the canonical camera in metres."""
    return depth * ((fx + fy) / 2) / 300.0


def hand_outliers(points: DataFrame, keys: list[str], radius: float = OUTLIER_RADIUS_M, min_likelihood: float = OUTLIER_LIKELIHOOD) -> DataFrame:
    """Flags of hand points far from their hand's median point. Rows: ``keys`` (a hand in a frame), joint
    (0 is the root and never flagged), x, y, z, lik. Hands of fewer than two valid points flag nothing."""
    hand = Window.partitionBy(*keys)
    valid = F.col("z").isNotNull() & F.coalesce(F.col("lik") >= min_likelihood, F.lit(False))
    centre = [F.percentile(F.when(valid, F.col(a)), F.lit(0.5)).over(hand) for a in "xyz"]
    away = F.sqrt(sum(((F.col(a) - c) ** 2 for a, c in zip("yz", centre[1:])), (F.col("x") - centre[0]) ** 2))
    n = F.count(F.when(valid, 1)).over(hand)
    flag = valid & (n >= 2) & (away > radius) & (F.col("joint") != 0)
    return points.withColumn("outlier", F.coalesce(flag, F.lit(False)))


def hand_boxes(points: DataFrame, keys: list[str], width: float, height: float, floor: float = 0.1, mean_floor: float = 0.3, scale: float = 2.0) -> DataFrame:
    """A box around each hand's visible points, clipped to the pixels of the frame, scaled about its centre, clipped
    again. Hands of fewer than two points, of low likelihood, and boxes without an extent give none."""
    there = finite(F.col("x")).isNotNull() & finite(F.col("y")).isNotNull() & (finite(F.col("lik")) > floor)
    seen = points.filter(there).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("lik").alias("mean_lik"), *[f(a).alias(f"{a}_{f.__name__}") for a in "xy" for f in (F.min, F.max)]
    ).filter((F.col("n") >= 2) & (F.col("mean_lik") >= mean_floor))
    clip = lambda c, top: F.greatest(F.lit(0.0), F.least(c, F.lit(float(top - 1))))
    boxes = seen.select(*keys, *[clip(F.col(f"{a}_{f}"), top).alias(f"{a}_{f}") for a, top in (("x", width), ("y", height)) for f in ("min", "max")])
    boxes = boxes.filter((F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min")))
    out = []
    for a, top in (("x", width), ("y", height)):
        centre, half = (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2, (F.col(f"{a}_max") - F.col(f"{a}_min")) * scale / 2
        lo, hi = clip(centre - half, top), clip(centre + half, top)
        out += [(a, lo), (f"size_{a}", hi - lo)]
    return boxes.select(*keys, *[c.alias(n) for n, c in out])


def bone_samples(frames: DataFrame, bones: list[tuple[str, str, int, int]], floors: list[float], dims: int = 3) -> DataFrame:
    """Lengths of confident bones: clip_key, bone, mirror_key, length. ``bones``: name, mirror key and slots."""
    k, out = F.col("kp"), []
    for name, mirror, i, j in bones:
        gap = sum(((k[i][a] - k[j][a]) ** 2 for a in "yz"[: dims - 1]), (k[i]["x"] - k[j]["x"]) ** 2)
        sure = (k[i]["lik"] >= floors[i]) & (k[j]["lik"] >= floors[j])
        out.append(F.struct(F.lit(name).alias("bone"), F.lit(mirror).alias("mirror_key"), F.when(sure, F.sqrt(gap)).alias("length")))
    return frames.select("clip_key", F.explode(F.array(*out)).alias("b")).select("clip_key", "b.*").filter("length is not null")


def bone_lengths(samples: DataFrame, bones: DataFrame, long_clips: bool = False) -> DataFrame:
    """clip_key, bone, n, median, std, cv of each bone; left and right are pooled. With ``long_clips``, medians are refined from counts, so
    that no clip's lengths meet in one task."""
    keys, facts = ["clip_key", "mirror_key"], [F.count("*").alias("n"), F.stddev_pop("length").alias("std_m")]
    if long_clips:
        pooled = samples.groupBy(*keys).agg(*facts).join(quantiles.grouped_median(samples, keys, "length", "median_m").drop("n"), keys)
    else:
        pooled = samples.groupBy(*keys).agg(*facts, F.median("length").alias("median_m"))
    cv = F.when(F.col("median_m") > 1e-9, F.col("std_m") / F.col("median_m"))
    return pooled.join(F.broadcast(bones), "mirror_key").select("clip_key", "bone", "n", "median_m", "std_m", cv.alias("cv"))  # a skeleton's bones


def bone_report(lengths: DataFrame) -> DataFrame:
    """The bones of each clip by descending spread, missing ones last, with their place."""
    place = F.row_number().over(Window.partitionBy("clip_key").orderBy(F.desc_nulls_last("cv"), "bone"))
    return lengths.withColumn("place", place).orderBy("clip_key", "place")


def relax(positions: np.ndarray, likelihood: np.ndarray, bones: list[tuple[int, int]], lengths: np.ndarray, floors: np.ndarray, iterations: int = 30, stiffness: float = 1.0) -> np.ndarray:
    """Positions (frames, joints, dims) after solving the bones one after the other, ``iterations`` times.

    Both ends move along the bone in proportion to their inverse mass, 1 over the likelihood (at least
    the floor). Bones without a length, or with a missing end, are skipped.
    """
    p = positions.copy()
    mass = 1.0 / np.maximum(np.where(np.isnan(likelihood), 0.0, likelihood), floors[None, :])
    there = np.isfinite(p).all(axis=2)
    usable = [(i, j, t, np.flatnonzero(there[:, i] & there[:, j])) for (i, j), t in zip(bones, lengths) if np.isfinite(t)]
    for _ in range(iterations):
        for i, j, target, rows in usable:
            if not len(rows):
                continue
            gap = p[rows, j] - p[rows, i]
            now = np.linalg.norm(gap, axis=1)
            share = mass[rows, i] / (mass[rows, i] + mass[rows, j])
            step = (stiffness * (now - target) / np.maximum(now, 1e-6))[:, None] * gap
            p[rows, i] += share[:, None] * step
            p[rows, j] -= (1 - share)[:, None] * step
    p[~there] = np.nan
    return p


def fit_skeleton(frames: DataFrame, bones: list[tuple[str, str, int, int]], floors: list[float], iterations: int = 30, stiffness: float = 1.0) -> DataFrame:
    """clip_key, frame_index, kp with the bones at their clip's median lengths. Frames are independent, so
    they are solved where they lie, in batches; a clip's lengths come along by a join."""
    keys = {m for _, m, _, _ in bones}
    pooled = bone_samples(frames, bones, floors).groupBy("clip_key").pivot("mirror_key", sorted(keys)).agg(F.median("length"))
    lengths = pooled.select("clip_key", F.array(*[F.col(f"`{m}`") for _, m, _, _ in bones]).alias("lengths"))
    joined = frames.select("clip_key", "frame_index", "kp").join(lengths, "clip_key", "left")
    edges, floor, axes = [(i, j) for _, _, i, j in bones], np.array(floors), ("x", "y", "z", "lik")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kp, target = batch.column("kp"), batch.column("lengths")
            joints = kp.flatten()
            raw = np.stack([joints.field(a).to_numpy(zero_copy_only=False).astype(float) for a in axes], axis=1).reshape(batch.num_rows, -1, 4)
            wanted = np.full((batch.num_rows, len(edges)), np.nan)
            there = np.flatnonzero(target.is_valid().to_numpy(zero_copy_only=False))
            wanted[there] = target.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(there), -1)
            known = np.nan_to_num(wanted, nan=-1.0)
            cuts = np.flatnonzero(np.append(True, (known[1:] != known[:-1]).any(axis=1)))  # rows of equal lengths are solved together
            for lo, hi in zip(cuts, np.append(cuts[1:], batch.num_rows)):
                raw[lo:hi, :, :3] = relax(raw[lo:hi, :, :3], raw[lo:hi, :, 3], edges, wanted[lo], floor, iterations, stiffness)
            flat = raw.reshape(-1, 4)
            fitted = pa.StructArray.from_arrays([pa.array(flat[:, i], mask=np.isnan(flat[:, i])) for i in range(4)], names=list(axes))
            offsets = pa.array(np.arange(batch.num_rows + 1) * raw.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("clip_key"), batch.column("frame_index"), pa.ListArray.from_arrays(offsets, fitted)], names=["clip_key", "frame_index", "kp"])

    kind = frames.schema["clip_key"].dataType.simpleString()
    index = frames.schema["frame_index"].dataType.simpleString()
    return joined.mapInArrow(run, f"clip_key {kind}, frame_index {index}, kp array<struct<x:double,y:double,z:double,lik:double>>")


def wrap_int16(c: Column) -> Column:
    """An integer as the signed 16-bit number with the same low bits."""
    return F.pmod(c + 32768, F.lit(65536)) - 32768


#: Values that are looked at one by one where a quantile lies.
QUANTILE_VALUES = 100_000


def exact_quantiles(df: DataFrame, column: str, shares: list[float], most: int = QUANTILE_VALUES) -> list[float | None]:
    """Quantiles of a whole column, interpolated between neighbours. Values are counted in buckets, and the bucket that
    holds the sought place is divided again until few enough values are left, so nothing grows with the table."""
    v = df.select(finite(F.col(column).cast("double")).alias("v")).filter("v is not null")
    n, least, greatest = v.agg(F.count("*"), F.min("v"), F.max("v")).first()

    def at(place: int) -> float:
        lo, hi, below, inside = least, greatest, 0, n
        while inside > most and lo < hi:
            bucket = F.least(F.lit(1023), F.floor((F.col("v") - lo) / ((hi - lo) / 1024)))
            rows = v.filter((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
            for r in sorted(rows, key=lambda r: r["b"]):
                if below + r["n"] > place:
                    lo, hi, inside = r["lo"], r["hi"], r["n"]
                    break
                below += r["n"]
        if lo == hi:
            return lo
        return sorted(r["v"] for r in v.filter((F.col("v") >= lo) & (F.col("v") <= hi)).collect())[place - below]

    out: list[float | None] = []
    for share in shares:
        if not n:
            out.append(None)
            continue
        place = (n - 1) * share
        low = at(int(place))
        out.append(low + (at(min(n - 1, int(place) + 1)) - low) * (place - int(place)))
    return out


def axis_limits(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, pad: float = 0.08) -> DataFrame:
    """Plot limits of each column: percentiles, padded by a share of their span. The percentiles are computed when it is called."""
    rows = []
    for c in columns:
        a, b = exact_quantiles(df, c, [low, high])
        rows.append((c, None, None) if a is None else (c, a - (b - a) * pad, b + (b - a) * pad))
    return df.sparkSession.createDataFrame(rows, "axis string, low double, high double")
