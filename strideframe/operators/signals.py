"""Per-frame kinematic signals of clips.

Input frames: clip_key, frame_index (dense, from 0), fps, kp (array of joints), other columns pass through.
One exchange on clip_key serves the shoulder width and all differences in time, or one on blocks of a clip where clips are
long; neighbours are rows of adjacent frame_index, whatever their frame numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strideframe.functions.expr import AXES, LIKELIHOOD, angle, distance, dot, joint, mean_of, norm, point
from strideframe.functions.skeleton import Layout, signal_names
from strideframe.operators import quantiles, scans


def shoulder_distance(layout: Layout, kp: str = "kp") -> Column:
    return distance(point(layout.slot("left_shoulder"), layout.dims, kp), point(layout.slot("right_shoulder"), layout.dims, kp))


def shoulder_width(frames: DataFrame, layout: Layout, long_clips: bool = False) -> DataFrame:
    """clip_key and the median over its frames of the masked shoulder distance; NULL if no frame has one. With ``long_clips``, it is
    refined from counts, so that no clip's distances meet in one task."""
    if not long_clips:
        return frames.groupBy("clip_key").agg(F.median(shoulder_distance(layout)).alias("shoulder_width"))
    widths = quantiles.grouped_median(frames.select("clip_key", shoulder_distance(layout).alias("_d")), ["clip_key"], "_d", "shoulder_width").drop("n")
    return frames.select("clip_key").distinct().join(widths, "clip_key", "left")


def likelihood_mask_rate(frames: DataFrame, layout: Layout, floor: float = LIKELIHOOD) -> DataFrame:
    """Joints of each clip and how many of them the likelihood floor masks."""
    masked = F.size(F.filter("kp", lambda k: k["lik"] < floor))
    return frames.groupBy("clip_key").agg(F.sum(F.size("kp")).alias("n_joints"), F.sum(masked).alias("n_masked"))


def body_frame(frames: DataFrame, layout: Layout) -> DataFrame:
    """Keypoints in the body's own axes: origin between the shoulders, x to the right shoulder, z toward
    the camera made orthogonal to x, y = z cross x. Frames without confident shoulders lose all coordinates."""
    left, right = layout.slot("left_shoulder"), layout.slot("right_shoulder")
    k = F.col("kp")
    raw = {s: [k[s][a] for a in AXES] for s in (left, right)}
    ok = (k[left]["lik"] >= LIKELIHOOD) & (k[right]["lik"] >= LIKELIHOOD)
    with_origin = frames.select(
        "*",
        F.struct(*[F.when(ok, (a + b) / 2).alias(n) for a, b, n in zip(raw[left], raw[right], AXES)]).alias("_o"),
        F.struct(*[((b - a) / 2).alias(n) for a, b, n in zip(raw[left], raw[right], AXES)]).alias("_r"),
    )
    o, r = ([F.col(c)[a] for a in AXES] for c in ("_o", "_r"))
    unit = with_origin.withColumn("_x", F.struct(*[F.try_divide(c, norm(r)).alias(a) for c, a in zip(r, AXES)]))
    x = [F.col("_x")[a] for a in AXES]
    forward = [-(-x[2]) * x[0], -(-x[2]) * x[1], -1.0 - (-x[2]) * x[2]]
    unit = unit.withColumn("_z", F.struct(*[F.try_divide(c, norm(forward)).alias(a) for c, a in zip(forward, AXES)]))
    z = [F.col("_z")[a] for a in AXES]
    y = [z[1] * x[2] - z[2] * x[1], z[2] * x[0] - z[0] * x[2], z[0] * x[1] - z[1] * x[0]]

    def turned(p: Column) -> Column:
        d = [p[a] - oc for a, oc in zip(AXES, o)]
        return F.struct(dot(x, d).alias("x"), dot(y, d).alias("y"), dot(z, d).alias("z"), p["lik"].alias("lik"))

    return unit.withColumn("kp", F.transform("kp", turned)).drop("_o", "_r", "_x", "_z")


def frame_signals(frames: DataFrame, layout: Layout, block: int | None = None) -> DataFrame:
    """The frames' columns, shoulder_width and one column for each signal, NULL where it is missing. With ``block``, clips may
    be of any length: widths are medians by refinement, and differences are taken in blocks of so many frames."""
    if block is None:
        clip = Window.partitionBy("clip_key")
        order = clip.orderBy("frame_index")
        frames = frames.withColumn("shoulder_width", F.percentile(shoulder_distance(layout), F.lit(0.5)).over(clip))
        return _signals(frames, layout, order)
    frames = scans.with_halo(frames.join(shoulder_width(frames, layout, True), "clip_key"), 2, 0, block=block)
    out = _signals(frames, layout, Window.partitionBy("clip_key", "_block").orderBy("frame_index"))
    return out.filter("_own").drop("_own", "_block")


def _signals(frames: DataFrame, layout: Layout, order: WindowSpec) -> DataFrame:
    if layout.dims == 3:
        frames = body_frame(frames, layout)
    d, axes = layout.dims, AXES[: layout.dims]
    sw = F.when(F.col("shoulder_width") > 0, F.col("shoulder_width"))
    p = {name: point(layout.slot(name), d) for s in ("left", "right") for name in (f"{s}_wrist_hand", f"{s}_shoulder", f"{s}_elbow", f"{s}_wrist")}
    tip = {(s, f): point(layout.tip(s, f), d) for s in ("left", "right") for f in layout.tips}
    root = {s: p[f"{s}_wrist_hand"] for s in ("left", "right")}

    def both(make) -> Column:
        return mean_of([make("left"), make("right")])

    out: dict[str, Column] = {
        "wrist_distance": distance(root["left"], root["right"]) / sw,
        "lr_keypoint_distance": mean_of([distance(point(a, d), point(b, d)) / sw for a, b in layout.matching()]),
        "hand_opening": both(lambda s: mean_of([distance(tip[s, f], root[s]) for f in layout.tips]) / sw),
        "index_thumb_distance": both(lambda s: distance(tip[s, "index"], tip[s, "thumb"]) / sw),
        "thumb_pinky_distance": both(lambda s: distance(tip[s, "thumb"], tip[s, "pinky"]) / sw),
    }
    hand_y = both(lambda s: root[s][1])
    if d == 2:
        out["hand_y_position"] = (hand_y - both(lambda s: p[f"{s}_shoulder"][1])) / sw
    else:
        out["hand_y_position"] = hand_y / sw
        out["elbow_angle"] = F.when(sw.isNotNull(), both(lambda s: angle(p[f"{s}_shoulder"], p[f"{s}_elbow"], p[f"{s}_wrist"])))
        out["hand_shoulder_distance"] = both(lambda s: distance(root[s], p[f"{s}_shoulder"]) / sw)
    # velocities in shoulder widths a second, then their differences
    v = {(s, a): (root[s][i] - F.lag(root[s][i]).over(order)) * F.col("fps") / sw for s in root for i, a in enumerate(axes)}
    moved = frames.select("*", *[c.alias(n) for n, c in out.items()], *[c.alias(f"_v_{s}_{a}") for (s, a), c in v.items()])
    acc = {(s, a): (F.col(f"_v_{s}_{a}") - F.lag(f"_v_{s}_{a}").over(order)) * F.col("fps") for s, a in v}
    moved = moved.select("*", *[c.alias(f"_a_{s}_{a}") for (s, a), c in acc.items()])
    for a in axes:
        for kind, short in (("speed", "v"), ("accel", "a")):
            moved = moved.withColumn(f"hand_{kind}_{a}", mean_of([F.abs(F.col(f"_{short}_{s}_{a}")) for s in root]))
    keep = [c for c in frames.columns if c != "kp"]
    return moved.select(*keep, *signal_names(d))


def timeseries(signals: DataFrame, names: list[str]) -> DataFrame:
    """frame, time since the clip's first frame by frame numbers, and the signals."""
    first = F.first("frame_number").over(Window.partitionBy("clip_key").orderBy("frame_index"))
    return signals.select("clip_key", F.col("frame_number").alias("frame"), ((F.col("frame_number") - first) / F.col("fps")).alias("time_s"), *names)
