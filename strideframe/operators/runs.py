"""Whole runs: lifting 2D poses to 3D with depth rasters, and fitting the full skeleton."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.expr import AXES, finite
from strideframe.functions.skeleton import BODYPARTS, bone_name, bones, mirror_key
from strideframe.operators import lifting, poses, tracks

#: Least likelihoods of joints of the body and of the hands.
BODY_FLOOR, HAND_FLOOR, N_BODY = 0.5, 0.05, 17


def smooth_points(long: DataFrame, axes: str, before: int, after: int, keys: list[str], valid: Column, order: str = "frame_index") -> DataFrame:
    """Each of ``axes`` as the median of the valid points among the rows from ``before`` back to ``after`` ahead, where
    the point itself is valid; other points stay as they are."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)
    marked = long.withColumn("_ok", F.coalesce(valid, F.lit(False)))
    new = [F.when(F.col("_ok"), F.percentile(F.when(F.col("_ok"), F.col(a)), F.lit(0.5)).over(w)).otherwise(F.col(a)).alias(a) for a in axes]
    return marked.select(*[c for c in long.columns if c not in axes], *new)


def smooth_poses(frames: DataFrame, size: int = 5, key: str = "clip_key") -> DataFrame:
    """key, frame_number, joint, x, y, lik: x and y smoothed in centred windows of ``size`` rows, over joints that are whole."""
    if size < 1 or size % 2 == 0:
        raise ValueError(f"window of {size} rows")
    place = F.row_number().over(Window.partitionBy(key).orderBy("frame_number")) - 1
    long = frames.withColumn("frame_index", place).select(key, "frame_index", "frame_number", F.posexplode("kp").alias("joint", "k")).select(key, "frame_index", "frame_number", "joint", "k.x", "k.y", "k.lik")
    whole = finite(F.col("x")).isNotNull() & finite(F.col("y")).isNotNull() & finite(F.col("lik")).isNotNull()
    return smooth_points(long, "xy", size // 2, size // 2, [key, "joint"], whole).select(key, "frame_number", "joint", "x", "y", "lik")


def lift_run(
    frames: DataFrame, rasters: DataFrame, hands: list[list[int]], shoulders: tuple[int, int], width: float, height: float, focal: float | None = None,
    metric: bool = False, min_likelihood: float = 0.5, radius: float = lifting.OUTLIER_RADIUS_M, z_window: int = 10, shoulder_width_m: float = lifting.SHOULDER_WIDTH_M,
    block: int | None = None,
) -> DataFrame:
    """run, frame_index, joint, x, y, z, lik in metres.

    ``frames``: run, frame_index, frame_number and pixels ``kp``; ``rasters``: run, frame_number, w, h, depth. A frame
    without a raster has no depth. One scale a run comes from its shoulders (none for metric depth); hand joints
    far from their hand's median point are interpolated in time; depth is smoothed, and x and y follow from it. With ``block``, runs may be
    of any length: the scale is a median by refinement, and a joint's track is filled and smoothed in blocks of so many frames.
    """
    fx = float(width if focal is None else focal)
    cx, cy = width / 2.0, height / 2.0
    joined = frames.join(rasters, ["run", "frame_number"], "left")
    depth_at = lambda k: lifting.bilinear(F.col("depth"), k["x"] * F.col("w") / float(width), k["y"] * F.col("h") / float(height), F.col("w"), F.col("h"))
    sampled = joined.select("run", "frame_index", "kp", F.transform("kp", depth_at).alias("raw"))
    if block is not None:
        sampled = sampled.persist()  # read by each pass of the median; spills, and is released by ``spark.catalog.clearCache()``
    if metric:
        scaled = sampled.withColumn("depth_scale", F.lit(1.0))
    else:
        left, right = shoulders
        k, r = F.col("kp"), F.col("raw")
        pairs = sampled.select(
            "run", *[k[s][a].alias(f"{n}{b}") for s, n in ((left, "l"), (right, "r")) for a, b in (("x", "x"), ("y", "y"), ("lik", "lik"))], r[left].alias("dl"), r[right].alias("dr")
        )
        scales = lifting.depth_scale(lifting.calibration_samples(pairs, min_likelihood), sampled.select("run").distinct(), F.lit(fx), shoulder_width_m, block is not None)
        scaled = sampled.join(scales.select("run", "depth_scale"), "run")
    if block is not None:
        take = lambda c: F.transform("kp", lambda k: k[c].cast("double"))
        depth = F.transform("raw", lambda v: v * F.col("depth_scale"))
        frames = scaled.select("run", "frame_index", take("x").alias("px"), take("y").alias("py"), take("lik").alias("lik"), depth.alias("z"))
        marked = tracks.flagged(frames, hands, (cx, cy), fx, radius, lifting.OUTLIER_LIKELIHOOD)
        smooth = tracks.smoothed(marked, (cx, cy), fx, z_window, block)
        points = smooth.select("run", "frame_index", F.posexplode(F.arrays_zip("x", "y", "z", "lik")).alias("joint", "p"))
        return points.select("run", "frame_index", "joint", "p.x", "p.y", "p.z", "p.lik")
    long = scaled.select("run", "frame_index", "depth_scale", F.posexplode(F.arrays_zip("kp", "raw")).alias("joint", "p")).select(
        "run", "frame_index", "joint", F.col("p.kp.x").alias("px"), F.col("p.kp.y").alias("py"), F.col("p.kp.lik").alias("lik"), (F.col("p.raw") * F.col("depth_scale")).alias("z")
    )
    z = F.col("z")
    of = [F.when(F.col("joint") == j, F.struct(F.lit(h).alias("hand"), F.lit(i).alias("place"))) for h, group in enumerate(hands) for i, j in enumerate(group)]
    placed = long.withColumn("_h", F.coalesce(*of, F.lit(None).cast("struct<hand:int,place:int>")))
    in_hand = placed.filter("_h is not null").select(
        "run", "frame_index", F.col("_h.hand").alias("hand"), F.col("joint").alias("slot"), F.col("_h.place").alias("joint"), "px", "py", "lik",
        ((F.col("px") - cx) * z / fx).alias("x"), ((F.col("py") - cy) * z / fx).alias("y"), "z",
    )
    flagged = lifting.hand_outliers(in_hand, ["run", "frame_index", "hand"], radius).select("run", "frame_index", F.col("slot").alias("joint"), "px", "py", "lik", "z", "outlier")
    every = flagged.union(placed.filter("_h is null").select("run", "frame_index", "joint", "px", "py", "lik", "z", F.lit(False)))
    track = ["run", "joint"]
    filled = every.select("run", "frame_index", "joint", "px", "py", "lik", poses.fill_gaps(every, "z", "outlier", track).alias("z"))
    smooth = filled.withColumn("z", poses.smooth(filled, "z", z_window, False, key=track))
    return smooth.select("run", "frame_index", "joint", ((F.col("px") - cx) * z / fx).alias("x"), ((F.col("py") - cy) * z / fx).alias("y"), "z", "lik")


def full_skeleton() -> tuple[list[tuple[str, str, int, int]], list[float]]:
    """The bones of the 59 joints without the legs below the hips, in solve order, and the joints' floors."""
    named = [(bone_name(BODYPARTS[i], BODYPARTS[j]), mirror_key(BODYPARTS[i], BODYPARTS[j]), i, j) for i, j in bones()]
    return named, [BODY_FLOOR] * N_BODY + [HAND_FLOOR] * (len(BODYPARTS) - N_BODY)


def fit_run(
    frames: DataFrame, skeleton: list[tuple[str, str, int, int]], floors: list[float], iterations: int = 30, stiffness: float = 1.0, window: int = 10
) -> tuple[DataFrame, DataFrame]:
    """(fitted, report). fitted: clip_key, frame_index, joint, x, y, z, lik after the fit and a median over ``window`` rows.
    report: clip_key, bone, and n, median_m, std_m, cv of the bone before and after the fit."""
    fitted = lifting.fit_skeleton(frames, skeleton, floors, iterations, stiffness)
    table = frames.sparkSession.createDataFrame([(n, m) for n, m, _, _ in skeleton], "bone string, mirror_key string")
    stats = lambda df, when: lifting.bone_lengths(lifting.bone_samples(df, skeleton, floors), table).select(
        "clip_key", "bone", *[F.col(c).alias(f"{c}_{when}") for c in ("n", "median_m", "std_m", "cv")]
    )
    report = stats(frames, "before").join(stats(fitted, "after"), ["clip_key", "bone"], "full_outer")
    long = fitted.select("clip_key", "frame_index", F.posexplode("kp").alias("joint", "k")).select("clip_key", "frame_index", "joint", "k.x", "k.y", "k.z", "k.lik")
    there = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    smooth = smooth_points(long, AXES, window // 2, window - window // 2 - 1, ["clip_key", "joint"], there) if window > 1 else long
    return smooth.select("clip_key", "frame_index", "joint", "x", "y", "z", "lik"), report


def lift_settings(width: int, height: int, focal: float, metric: bool, scale: Column, n_samples: Column, shoulder_width_m: float = lifting.SHOULDER_WIDTH_M) -> Column:
    """The parameters of a lift as JSON."""
    return F.to_json(F.struct(
        (F.lit(metric) | (n_samples > 0)).alias("is_metric"), scale.alias("depth_scale"), F.lit(float(focal)).alias("assumed_focal_length_px"),
        F.lit(shoulder_width_m).alias("shoulder_width_m"), n_samples.alias("n_calibration_samples"), F.lit(width).alias("frame_width"), F.lit(height).alias("frame_height"),
    ))


def fit_settings(report: DataFrame, iterations: int = 30, stiffness: float = 1.0, window: int = 10, body_floor: float = BODY_FLOOR, hand_floor: float = HAND_FLOOR) -> DataFrame:
    """clip_key and ``settings``: the parameters of a fit and the lengths it aimed at (null where unknown) as JSON, from the fit's report."""
    lengths = F.map_from_entries(F.array_sort(F.collect_list(F.struct("bone", "median_m_before"))))  # a skeleton's bones
    rows = report.groupBy("clip_key").agg(lengths.alias("of"))
    settings = F.struct(
        F.lit(iterations).alias("iterations"), F.lit(float(stiffness)).alias("stiffness"), F.lit(body_floor).alias("min_likelihood"), F.lit(hand_floor).alias("min_likelihood_hand"),
        F.lit(window).alias("post_fit_smoothing_window"), F.col("of").alias("reference_lengths_m"),
    )
    return rows.select("clip_key", F.to_json(settings, {"ignoreNullFields": "false"}).alias("settings"))
