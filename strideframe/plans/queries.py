"""The motion and signal operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.expr import mean_of, point
from strideframe.functions.skeleton import SMALL_2D, SMALL_3D, dtw_channels, feature_names, signal_names
from strideframe.operators import features, graph, lifting, matching, poses, progress, quantiles, scans, signals
from strideframe.sources import adapters, depth

DIGITS = 6
FLAGS = [f"s{k}" for k in range(1, 8)]
#: Bones of the 16-slot skeleton: name, mirror key, slots.
BONES_3D = [
    ("left_shoulder-left_elbow", "left_shoulder-left_elbow", 0, 2), ("right_shoulder-right_elbow", "left_shoulder-left_elbow", 1, 3),
    ("left_elbow-left_wrist", "left_elbow-left_wrist", 2, 4), ("right_elbow-right_wrist", "left_elbow-left_wrist", 3, 5), ("left_shoulder-right_shoulder", "left_shoulder-right_shoulder", 0, 1),
]
FLOORS_3D = [0.5] * 6 + [0.05] * 10


def rounded(df: DataFrame, names: list[str], digits: int = DIGITS) -> DataFrame:
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if c in names else F.col(c) for c in df.columns])


def shoulder_width(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signals.shoulder_width(adapters.pose_2d(spark, d), SMALL_2D), ["shoulder_width"])


def likelihood_mask_rate(spark: SparkSession, d: str) -> DataFrame:
    return signals.likelihood_mask_rate(adapters.pose_2d(spark, d), SMALL_2D)


def nanmean_rowwise(spark: SparkSession, d: str) -> DataFrame:
    tips = [SMALL_2D.tip(s, f) for s in ("left", "right") for f in SMALL_2D.tips]
    out = mean_of([point(t, 2)[1] for t in tips])
    return rounded(adapters.pose_2d(spark, d).select("clip_key", "frame_number", out.alias("mean_tip_y")), ["mean_tip_y"])


def _signals(spark: SparkSession, d: str, layout) -> DataFrame:
    """The signals, cached: several consumers of a query read them, and the cached relation keeps their generated code
    small. It spills to disk and is made anew if an executor goes; ``spark.catalog.clearCache()`` releases it."""
    frames = adapters.pose_2d(spark, d) if layout.dims == 2 else adapters.pose_3d(spark, d)
    return signals.frame_signals(frames, layout).persist()


def frame_signals_2d(spark: SparkSession, d: str) -> DataFrame:
    names = signal_names(2)
    return rounded(_signals(spark, d, SMALL_2D).select("clip_key", "frame_number", *names), names, 5)


def frame_signals_long(spark: SparkSession, d: str) -> DataFrame:
    names = signal_names(2)
    out = signals.frame_signals(adapters.long_pose_2d(spark, d), SMALL_2D, block=adapters.CLIP_IDS)
    return rounded(out.select("clip_key", "frame_number", *names), names, 5)


def frame_signals_3d(spark: SparkSession, d: str) -> DataFrame:
    names = signal_names(3)
    out = signals.frame_signals(adapters.long_pose_3d(spark, d), SMALL_3D, block=adapters.CLIP_IDS).persist()  # keeps the generated code small
    return rounded(out.select("clip_key", "frame_number", *names), names, 4)


def timeseries_time_s(spark: SparkSession, d: str) -> DataFrame:
    out = signals.timeseries(_signals(spark, d, SMALL_2D), ["wrist_distance"])
    return rounded(out, ["time_s", "wrist_distance"])


def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet").select(F.date_format("ts", "yyyy-MM-dd HH").alias("frame"), "event_type", "event_id", "value")
    source = lambda kind: poses.collapse_duplicates(events.filter(F.col("event_type") == kind), ["frame"], "value", "event_id")
    return rounded(poses.merge_sources({"body": source("click"), "full_body": source("view"), "hand": source("purchase")}, "frame", "value"), ["body_value", "full_body_value", "hand_value", "value"])


def smooth_centered(spark: SparkSession, d: str) -> DataFrame:
    s = adapters.signal(spark, d).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return rounded(scans.smooth(s, "value", 5, True).select("clip_key", "frame_number", "smoothed"), ["smoothed"])


def smooth_asymmetric(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scans.smooth(adapters.signal(spark, d), "value", 10, False).select("clip_key", "frame_number", "smoothed"), ["smoothed"])


def gap_interpolation(spark: SparkSession, d: str) -> DataFrame:
    s = adapters.signal(spark, d).withColumn("flagged", F.col("event_type") == "error")
    return rounded(scans.fill_gaps(s, "value", "flagged").select("clip_key", "frame_number", "filled"), ["filled"])


def locf(spark: SparkSession, d: str) -> DataFrame:
    s = adapters.signal(spark, d).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return rounded(scans.carry_forward(s, "value").select("clip_key", "frame_number", "carried"), ["carried"])


def signal_changes(spark: SparkSession, d: str) -> DataFrame:
    s = scans.differences(adapters.signal(spark, d), ["value"], F.col("fps"))
    return rounded(s.select("clip_key", "frame_number", F.col("d1_value").alias("speed"), F.col("d2_value").alias("acceleration")), ["speed", "acceleration"], 4)


def event_type_quantiles(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    shares = {"low": 0.01, "first_quarter": 0.25, "middle": 0.5, "last_quarter": 0.75, "high": 0.99}
    return rounded(quantiles.grouped_quantiles(events, ["event_type"], "value", shares), list(shares))


def midpoint_window(spark: SparkSession, d: str) -> DataFrame:
    return poses.midpoint_rows(adapters.signal(spark, d)).select("clip_key", "frame_index", "is_middle")


def reference_length_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.reference_lengths(adapters.signal(spark, d)), ["fps", "duration_s", "diff_from_mean_frames", "diff_from_mean_s"])


def window_size(spark: SparkSession, d: str) -> DataFrame:
    return features.window_sizes(adapters.signal(spark, d))


def _event_features(spark: SparkSession, d: str) -> DataFrame:
    s = adapters.signal(spark, d)
    sizes = features.window_sizes(s)
    halved = sizes.select("fps", F.greatest(F.lit(2), F.bround(F.col("window_frames") / 4).cast("int")).alias("window_frames"))
    return features.feature_table(s, ["value"], ["clip_key", "clip_id", "is_reference"], halved)


def sliding_window_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_event_features(spark, d), ["value_mean", "value_std"])


def _pose_features(spark: SparkSession, d: str, layout=SMALL_2D) -> DataFrame:
    s = _signals(spark, d, layout)
    sizes = features.window_sizes(s).select("fps", F.greatest(F.lit(2), F.bround(F.col("window_frames") / 4).cast("int")).alias("window_frames"))
    return features.feature_table(s, signal_names(layout.dims), ["clip_key", "clip_id", "is_reference"], sizes).persist()


def pose_window_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pose_features(spark, d), feature_names(2), 4)


def pose_window_features_3d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_pose_features(spark, d, SMALL_3D), feature_names(3), 3)


def dropna_features(spark: SparkSession, d: str) -> DataFrame:
    table = features.drop_incomplete(_pose_features(spark, d), feature_names(2))
    return table.groupBy("clip_id").agg(F.count("*").alias("windows"))


def normalize_per_clip(spark: SparkSession, d: str) -> DataFrame:
    f = ["value_mean", "value_std"]
    table = features.drop_incomplete(_event_features(spark, d), f)
    return rounded(features.normalise_at_scale(table, f).select("clip_id", "is_reference", "window_index", *f), f, 4)


def standard_scaler(spark: SparkSession, d: str) -> DataFrame:
    f = ["value_mean", "value_std"]
    table = features.drop_incomplete(_event_features(spark, d), f)
    return rounded(features.standard_scale(table, f).select("clip_id", "window_index", *f), f, 4)


def pca_projection(spark: SparkSession, d: str) -> DataFrame:
    f = feature_names(2)
    table = features.normalise_at_scale(features.drop_incomplete(_pose_features(spark, d), f), f)
    return features.pca(features.standard_scale(table, f), f).select("clip_id", "window_index", "is_reference", "pc1", "pc2", "explained1", "explained2")


def _points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id"), F.col("label"), e[0].alias("u"), e[1].alias("v"))


def knn_reference_windows(spark: SparkSession, d: str) -> DataFrame:
    p = _points(spark, d)
    refs = p.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "u", "v")
    windows = p.filter(F.col("vec_id") % 100 != 0).select(F.col("vec_id").alias("window_index"), "u", "v")
    return rounded(matching.nearest_windows(refs, windows, ["u", "v"]).select("query_id", "window_index", "distance", "rank"), ["distance"])


def neighbour_graph(spark: SparkSession, d: str) -> DataFrame:
    """The fuzzy graph of about 15 nearest neighbours of each vector."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return graph.fuzzy_union(graph.neighbour_graph(vectors))


def convex_hull(spark: SparkSession, d: str) -> DataFrame:
    return matching.convex_hull(_points(spark, d), "label", "u", "v")


CHANNELS, CHANNELS_3D = dtw_channels(2), dtw_channels(3)


def channel_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.channel_stats(_signals(spark, d, SMALL_2D), CHANNELS), ["mean", "std", "raw_std"], 5)


def global_channel_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.global_channel_scale(_signals(spark, d, SMALL_2D), CHANNELS), ["scale"], 5)


def channel_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.channel_weights(_signals(spark, d, SMALL_2D), CHANNELS), ["weight"], 5)


def channel_zscore(spark: SparkSession, d: str) -> DataFrame:
    s = adapters.signal(spark, d)
    out = matching.channel_zscores(s, matching.channel_stats(s, ["value"]), "user_00010", ["value"])
    return rounded(out.select("clip_key", "frame_number", "value"), ["value"], 5)


def _event_clips(spark: SparkSession, d: str) -> DataFrame:
    """The event signals, cached as in ``_signals``: matching reads them several times."""
    return adapters.signal(spark, d).drop("event_type", "category", "fps").persist()


def dtw_best_match(spark: SparkSession, d: str) -> DataFrame:
    out = matching.dtw_matches(_event_clips(spark, d), ["value"])
    return rounded(out.drop("clip_id"), ["normalized_cost"])


def dtw_top_matches(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.top_matches(matching.dtw_matches(_event_clips(spark, d), ["value"], k=5)), ["normalized_cost"])


def dtw_pose_match(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.dtw_matches(_signals(spark, d, SMALL_2D), CHANNELS), ["normalized_cost"])


def channel_weights_3d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.channel_weights(_signals(spark, d, SMALL_3D), CHANNELS_3D), ["weight"], 4)


def weight_report(spark: SparkSession, d: str) -> DataFrame:
    weights = matching.channel_weights(_signals(spark, d, SMALL_2D), CHANNELS)
    return rounded(matching.weight_report(weights), ["weight"], 5)


def dtw_pose_match_3d(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.dtw_matches(_signals(spark, d, SMALL_3D), CHANNELS_3D), ["normalized_cost"])


def match_overlay_progress(spark: SparkSession, d: str) -> DataFrame:
    s = adapters.signal(spark, d)
    spans = s.filter("not is_reference").groupBy("clip_key").agg(
        F.lit("user_00010").alias("reference_id"), (F.min("frame_index") + 3).alias("start"), F.lit(12).alias("window_length_frames")
    )
    return rounded(matching.match_overlay(s, spans, ["value"]), ["progress", "value"])


def match_overlay_channels(spark: SparkSession, d: str) -> DataFrame:
    s = adapters.signal(spark, d)
    spans = s.filter("not is_reference").groupBy("clip_key").agg(
        F.lit("user_00010").alias("reference_id"), (F.min("frame_index") + 3).alias("start"), F.lit(12).alias("window_length_frames")
    )
    return rounded(matching.overlay_channels(s, spans, ["value"]), ["progress", "value"], 5)


def hand_boxes_of_frames(spark: SparkSession, d: str) -> DataFrame:
    boxes = hand_bboxes(spark, d).filter("frame_number % 6 <> 0").groupBy("frame_number").agg(F.count("*").alias("boxes"), F.max("side").alias("last_side"))
    return adapters.pose_3d(spark, d).select("frame_number").join(boxes, "frame_number", "left").na.fill({"boxes": 0})


def dtw_match_overlay(spark: SparkSession, d: str) -> DataFrame:
    s = _event_clips(spark, d)
    return rounded(matching.match_overlay(s, matching.top_matches(matching.dtw_matches(s, ["value"], k=5)), ["value"]), ["progress", "value"])


def dtw_match_table(spark: SparkSession, d: str) -> DataFrame:
    """The best five clips of each reference with their people and the names of their excerpts."""
    s = _event_clips(spark, d)
    people = s.select("clip_id", F.col("clip_key").cast("string").alias("participant_id"), F.format_string("S%d", F.col("clip_key") % 7).alias("school")).distinct()
    return progress.match_excerpts(rounded(matching.match_table(matching.dtw_matches(s, ["value"], k=5), people), ["normalized_cost"]))


def depth_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Rasters packed into blocks of frames and unpacked: how many sky pixels come back, and whether depth does to the precision of a half float."""
    r = adapters.rasters(spark, d).withColumn("sky", F.transform("depth", lambda v: v > 0.15))
    frames = r.select(F.col("run").cast("string").alias("run"), F.col("frame_number").cast("int").alias("frame_number"), F.lit(False).alias("is_metric"), "h", "w", F.col("depth").cast("array<float>").alias("depth"), "sky")
    back = depth.decode(depth.encode(frames)).select("run", "frame_number", F.col("depth").alias("b"), F.col("sky").alias("s"))
    gap = F.array_max(F.transform(F.arrays_zip("depth", "b"), lambda z: F.abs(z["depth"] - z["b"]) / F.greatest(F.lit(6.2e-5), z["depth"])))
    return frames.join(back, ["run", "frame_number"], "left").select(F.col("run").cast("long").alias("run"), "frame_number", F.size(F.filter("s", lambda v: v)).alias("sky_pixels"), (gap <= 2.0**-10).alias("close"))


def _bone_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, m) for n, m, _, _ in BONES_3D], "bone string, mirror_key string")


def bone_lengths(spark: SparkSession, d: str) -> DataFrame:
    samples = lifting.bone_samples(adapters.pose_3d(spark, d), BONES_3D, FLOORS_3D)
    return rounded(lifting.bone_lengths(samples, _bone_table(spark)), ["median_m", "std_m", "cv"])


def bone_length_cv_report(spark: SparkSession, d: str) -> DataFrame:
    samples = lifting.bone_samples(adapters.pose_3d(spark, d), BONES_3D, FLOORS_3D)
    return rounded(lifting.bone_report(rounded(lifting.bone_lengths(samples, _bone_table(spark)), ["cv"])), ["median_m", "std_m", "cv"])


def pbd_fit_skeleton(spark: SparkSession, d: str) -> DataFrame:
    fitted = lifting.fit_skeleton(adapters.pose_3d(spark, d), BONES_3D, FLOORS_3D)
    samples = lifting.bone_samples(fitted, BONES_3D, FLOORS_3D)
    return lifting.bone_lengths(samples, _bone_table(spark))


def depth_bilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    r = adapters.rasters(spark, d)
    x, y = F.pmod("frame_number", F.lit(11)) * 0.77 - 0.4, F.pmod("frame_number", F.lit(7)) * 1.21 - 0.3
    return rounded(r.select("frame_number", lifting.bilinear(F.col("depth"), x, y, F.col("w"), F.col("h")).alias("depth_at")), ["depth_at"])


def _shoulder_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = adapters.pose_2d(spark, d).select("clip_key", "frame_number", "kp")
    r = adapters.rasters(spark, d)
    k = F.col("kp")
    at = lambda s: lifting.bilinear(F.col("depth"), (k[s]["x"] + 1) * 3, (k[s]["y"] + 1) * 3, F.col("w"), F.col("h"))
    return p.join(r, "frame_number", "left").select(  # a pose without a raster has no depth
        F.col("clip_key").alias("run"), "frame_number",
        *[k[s][a].alias(f"{n}{b}") for s, n in ((0, "l"), (1, "r")) for a, b in (("x", "x"), ("y", "y"), ("lik", "lik"))], at(0).alias("dl"), at(1).alias("dr"),
    )


def depth_calibrate_scale(spark: SparkSession, d: str) -> DataFrame:
    pairs = _shoulder_pairs(spark, d)
    return rounded(lifting.depth_scale(lifting.calibration_samples(pairs), pairs.select("run").distinct(), F.lit(8.0)), ["depth_scale"])


def backproject_lift(spark: SparkSession, d: str) -> DataFrame:
    pairs = _shoulder_pairs(spark, d)
    p = lifting.backproject(F.col("lx"), F.col("ly"), F.col("dl"), F.lit(8.0), F.lit(8.0), F.lit(4.0), F.lit(4.0))
    return rounded(pairs.select("frame_number", p.alias("p")).select("frame_number", "p.x", "p.y", "p.z"), ["x", "y", "z"])


def _hand_points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("kp")
    rows = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(j).alias("joint"), k[slot].alias("k")) for s, slots in (("left", (6, 8, 9, 10)), ("right", (7, 11, 12, 13))) for j, slot in enumerate(slots)])
    return adapters.pose_3d(spark, d).select("frame_number", F.explode(rows).alias("r")).select("frame_number", "r.side", "r.joint", "r.k.*")


def hand_outlier_flags(spark: SparkSession, d: str) -> DataFrame:
    return lifting.hand_outliers(_hand_points(spark, d), ["frame_number", "side"]).select("frame_number", "side", "joint", "outlier")


def hand_bboxes(spark: SparkSession, d: str) -> DataFrame:
    points = _hand_points(spark, d).withColumn("x", (F.col("x") + 1) * 320).withColumn("y", (F.col("y") + 1) * 240)
    return rounded(lifting.hand_boxes(points, ["frame_number", "side"], 640, 480), ["x", "y", "size_x", "size_y"])


def depth_delta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    s = adapters.signal(spark, d).withColumn("raw", lifting.wrap_int16(F.floor(F.col("value") * 1000)))
    s = scans.delta_decode(scans.delta_encode(s, "raw", lifting.wrap_int16), "delta", lifting.wrap_int16)
    return s.select("clip_key", "frame_number", "raw", "delta", "decoded")


def axis_limits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lifting.axis_limits(_points(spark, d), ["u", "v"]), ["low", "high"])


def progress_stages(spark: SparkSession, d: str) -> DataFrame:
    return progress.stage_counts(adapters.hierarchy(spark, d), FLAGS)


def progress_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(progress.rollup(adapters.hierarchy(spark, d), FLAGS), ["percent_complete"])


def progress_totals(spark: SparkSession, d: str) -> DataFrame:
    return progress.totals(adapters.hierarchy(spark, d))


def progress_missing_stage(spark: SparkSession, d: str) -> DataFrame:
    out = progress.filter_recordings(adapters.hierarchy(spark, d), FLAGS, search="nation_1", status="incomplete", missing="s3")
    return out.select("school", "participant", "recording", "completed")


def reference_ids(spark: SparkSession, d: str) -> DataFrame:
    return progress.reference_ids(adapters.signal(spark, d))


def participant_palette_rank(spark: SparkSession, d: str) -> DataFrame:
    people = adapters.hierarchy(spark, d).select("school", "participant").distinct()
    return rounded(progress.participant_shades(people), ["lightness"])


def stale_runs_antijoin(spark: SparkSession, d: str) -> DataFrame:
    h = progress.stage_counts(adapters.hierarchy(spark, d), FLAGS)
    return progress.stale(h.select("recording", "completed"), h.filter("s7 = 1").select("recording"), ["recording"])


def unknown_references(spark: SparkSession, d: str) -> DataFrame:
    s = adapters.signal(spark, d)
    return progress.unknown_references(s.select("clip_id").distinct(), s)


def person_frame_flatten(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    person = lambda o: F.array(*[F.array(e[o + 3 * j], e[o + 3 * j + 1], F.abs(e[o + 3 * j + 2])) for j in range(3)])
    frames = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.array(person(0), person(9)).alias("persons"))
    flat = poses.flatten_persons(frames)
    return flat.select("frame", "person_id", *[(F.col("kp")[j][i] + 0.0).alias(f"kpt{j}_{n}") for j in range(3) for i, n in enumerate(("x", "y", "score"))])


def props_field(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("sum_k"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        shoulder_width, likelihood_mask_rate, nanmean_rowwise, frame_signals_2d, frame_signals_3d, frame_signals_long, signal_changes, event_type_quantiles, timeseries_time_s, merge_sources, smooth_centered,
        smooth_asymmetric, gap_interpolation, locf, midpoint_window, reference_length_table, window_size, sliding_window_features, pose_window_features, pose_window_features_3d,
        dropna_features, normalize_per_clip, standard_scaler, pca_projection, knn_reference_windows, neighbour_graph, convex_hull, channel_stats, global_channel_scale,
        channel_weights, channel_weights_3d, weight_report, channel_zscore, dtw_best_match, dtw_top_matches, dtw_pose_match, dtw_pose_match_3d, match_overlay_progress, match_overlay_channels, hand_boxes_of_frames, dtw_match_overlay, dtw_match_table, depth_blocks, bone_lengths, bone_length_cv_report,
        pbd_fit_skeleton, depth_bilinear_sample, depth_calibrate_scale, backproject_lift, hand_outlier_flags, hand_bboxes, depth_delta_roundtrip,
        axis_limits, progress_stages, progress_rollup, progress_totals, progress_missing_stage, reference_ids, participant_palette_rank,
        stale_runs_antijoin, unknown_references, person_frame_flatten, props_field,
    )
}
