"""Queries of sources, paths, merging, lifting and fitting over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.skeleton import SMALL_3D
from strideframe.operators import lifting, poses, progress, runs, scans, tracks
from strideframe.plans.oracles import POSE, POSE_LONG, SIGNAL, _bilinear
from strideframe.sources import adapters, files

STAGES = list(files.STAGE_FILES)
HANDS = [[6, 8, 9, 10, 11, 12], [7, 13, 14, 15, 16, 17]]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _six(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if c in names else F.col(c) for c in df.columns])


def _e(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def frame_numbers(spark: SparkSession, d: str) -> DataFrame:
    labels = _table(spark, d, "events").select(F.format_string("frame_%04d", "event_id").alias("label"))
    return labels.select("label", files.frame_number(F.col("label")).alias("frame_number"))


def participant_paths(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    who = F.concat(F.when(o % 2 == 0, "P").otherwise("p"), F.col("o_custkey").cast("string"))
    run = F.concat(F.lit("recording_"), who, F.lit("_task"), (o % 5).cast("string"), F.when(o % 3 == 0, "").otherwise(F.concat(F.lit("__"), (o % 3).cast("string"))), F.lit(".mp4"))
    path = F.concat(F.lit("/data/S"), (F.col("o_custkey") % 9).cast("string"), F.lit("/P"), F.col("o_custkey").cast("string"), F.lit("/"), run, F.lit("/results_"), run, F.lit("_merged.csv"))
    rows = _table(spark, d, "orders").select("o_orderkey", path.alias("path")).filter(files.is_participant_csv(F.col("path")))
    return rows.select("o_orderkey", *[c.alias(n) for n, c in files.participant_meta(F.col("path")).items()])


def reference_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    path = F.concat(F.when(p % 2 == 0, "/ref/set_IrrelevantDA").otherwise("/ref/set_relevantDA"), F.lit("/pose_estimation/pose_3d_predictions/results_clip_"), p.cast("string"), F.lit(".mp4_3d.csv"))
    rows = _table(spark, d, "part").select("p_partkey", files.companion_2d(path).alias("path")).filter(files.is_reference_csv(F.col("path")))
    return rows.select("p_partkey", "path", *[c.alias(n) for n, c in files.reference_meta(F.col("path")).items()])


def frame_rates(spark: SparkSession, d: str) -> DataFrame:
    fps = F.when(F.col("event_id") % 3 == 1, F.col("value") / 1e6).when(F.col("event_id") % 3 == 2, F.col("value"))
    return _six(_table(spark, d, "events").select("event_id", files.fps_or_default(fps).alias("fps")), ["fps"])


def _files_of_orders(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    name = (
        F.when(n == 1, "visualization_a.mp4").when(n == 2, "results_b.avi").when(n == 3, F.concat(F.lit("clip_"), F.col("l_partkey").cast("string"), F.lit(".mp4")))
        .when(n == 4, F.concat(F.lit("x"), F.col("l_suppkey").cast("string"), F.lit(".AVI"))).otherwise("notes.txt")
    )
    return _table(spark, d, "lineitem").select(F.concat(F.lit("/r/"), F.col("l_orderkey").cast("string"), F.lit("/"), name).alias("path"))


def run_videos(spark: SparkSession, d: str) -> DataFrame:
    return files.first_videos(_files_of_orders(spark, d))


def stale_cache(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    listed = _table(spark, d, "customer").select(F.concat(F.lit("/clips/"), c.cast("string")).alias("path"), c.alias("modificationTime"))
    cached = _table(spark, d, "customer").filter(c % 3 != 0).select(files.cache_key(F.concat(F.lit("/clips/"), c.cast("string"))).alias("key"), (c + F.when(c % 5 == 0, 1).otherwise(0)).alias("source_mtime"))
    return files.stale_clips(listed, cached).select("path", "key")


def _recording_files(spark: SparkSession, d: str) -> DataFrame:
    o, run = F.col("l_orderkey"), F.concat(F.lit("recording_"), F.col("l_orderkey").cast("string"), F.lit(".mp4"))
    name = F.element_at(F.array(*[F.concat(F.lit(x.split("{run}")[0]), run, F.lit(x.split("{run}")[1])) for x in files.STAGE_FILES.values()]), F.col("l_linenumber"))
    inside = F.concat(F.lit("/d/S"), (o % 7).cast("string"), F.lit("/P"), (o % 50).cast("string"), F.lit("/"), run, F.lit("/"), name)
    # a seventh of the files lies in schools without recordings
    return _table(spark, d, "lineitem").select(F.when(o % 7 == 6, F.concat(F.lit("/d/S"), (o % 21).cast("string"), F.lit("/readme.txt"))).otherwise(inside).alias("path"))


def scan_recordings(spark: SparkSession, d: str) -> DataFrame:
    return files.scan_recordings(_recording_files(spark, d))


def scan_schools(spark: SparkSession, d: str) -> DataFrame:
    return files.scan_schools(_recording_files(spark, d), 3)


def whole_body_joints(spark: SparkSession, d: str) -> DataFrame:
    points = F.transform(F.sequence(F.lit(0), F.lit(132)), lambda i: F.get("e", (i * 7) % 64))
    return _six(_e(spark, d).select("vec_id", F.posexplode(poses.whole_body_to_joints(points)).alias("joint", "v")), ["v"])


def hand_slots(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id") % 4
    labels = F.when(v == 0, F.array().cast("array<string>")).when(v == 1, F.array(F.lit("left"))).when(v == 2, F.array(F.lit("right"), F.lit("left"))).otherwise(F.array(F.lit("right")))
    hands = F.array(F.slice("e", 1, 21), F.slice("e", 22, 21))
    return _six(_e(spark, d).select("vec_id", F.posexplode(poses.place_hands(labels, hands)).alias("slot", "v")), ["v"])


def frame_stride(spark: SparkSession, d: str) -> DataFrame:
    return poses.frame_range(_e(spark, d).select(F.col("vec_id").alias("frame_number")), 10, 400, 7)


def visible_extents(spark: SparkSession, d: str) -> DataFrame:
    seen = poses.visible_joints(adapters.pose_3d(spark, d), [SMALL_3D.slot("left_elbow"), SMALL_3D.slot("right_elbow")])
    return _six(poses.extents(seen, "xyz"), [f"{a}_{x}" for a in "xyz" for x in ("low", "high")])


def pixel_extents(spark: SparkSession, d: str) -> DataFrame:
    points = _e(spark, d).select(F.col("label").alias("clip_key"), F.col("e")[0].alias("x"), F.col("e")[1].alias("y"))
    return _six(poses.extents(points, "xy"), [f"{a}_{x}" for a in "xy" for x in ("low", "high")])


def trail_alphas(spark: SparkSession, d: str) -> DataFrame:
    rows = poses.midpoint_rows(adapters.signal(spark, d))
    age = F.row_number().over(poses.Window.partitionBy("clip_key").orderBy("frame_index")) - 1
    return _six(rows.select("clip_key", F.col("frame_index").cast("long").alias("frame_index"), poses.trail_alpha(age, F.lit(10)).alias("alpha")), ["alpha"])


def companion_pixels(spark: SparkSession, d: str) -> DataFrame:
    three, two = adapters.pose_3d(spark, d), adapters.pose_2d(spark, d)
    two = two.filter((F.col("clip_key") % 2 == 0) | (F.col("frame_number") % 10 != 0))
    out = poses.companion_pixels(three, two)
    return _six(out.select("clip_key", "frame_number", F.col("kp_2d")[0]["x"].alias("px"), F.col("kp_2d")[0]["y"].alias("py")), ["px", "py"])


def frame_mismatches(spark: SparkSession, d: str) -> DataFrame:
    p = adapters.pose_2d(spark, d)
    return poses.frame_mismatches(p.filter("frame_number % 11 <> 0"), p.filter("frame_number % 7 <> 0"))


def neighbour_excerpts(spark: SparkSession, d: str) -> DataFrame:
    u, i = F.col("user_id"), F.col("event_id")
    found = _table(spark, d, "events").select(
        (i % 10 + 1).cast("int").alias("rank"), F.format_string("U%d", u).alias("participant_id"), F.format_string("c%d", u % 3).alias("clip_id"), (i % 97).alias("window_start_frame"), (i % 13 + 2).alias("n_frames")
    )
    c = F.col("c_custkey")
    clips = _table(spark, d, "customer").filter(c % 2 == 0).select(F.format_string("U%d", c).alias("participant_id"), F.format_string("c%d", c % 3).alias("clip_id"), F.format_string("S%d", "c_nationkey").alias("school"))
    return progress.neighbour_clips(found, clips).select("school", "excerpt")


def times_ago(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", progress.seconds_ago(F.col("event_id").cast("double") * 1.5).alias("ago"))


def depth_model_kinds(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey") % 4
    name = F.when(p == 0, "org/DA3METRIC-LARGE/").when(p == 1, "org/DA3NESTED-Metric").when(p == 2, "metric/DA3MONO-large").otherwise("DA3-BASE")
    return _table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in progress.model_kinds(name).items()])


def people_of_schools(spark: SparkSession, d: str) -> DataFrame:
    return progress.select_people(adapters.hierarchy(spark, d), ["NATION_1", "NATION_3"], list(range(0, 150, 3))).select("school", "participant", "recording")


def preview_frames(spark: SparkSession, d: str) -> DataFrame:
    return adapters.pose_2d(spark, d).select("frame_number", "clip_key").orderBy("frame_number").limit(60)


def depth_of_frames(spark: SparkSession, d: str) -> DataFrame:
    p = adapters.pose_2d(spark, d).select("frame_number")
    r = adapters.rasters(spark, d).filter("frame_number % 4 <> 0").select("frame_number", (F.col("frame_number") % 3 == 0).alias("is_metric"), lifting.metric_depth(F.col("depth")[0], F.lit(500.0), F.lit(700.0)).alias("metres"))
    return _six(p.join(r, "frame_number", "left"), ["metres"])


def sky_bits(spark: SparkSession, d: str) -> DataFrame:
    flags = F.transform("e", lambda v: v > 0)
    rows = _e(spark, d).select("vec_id", flags.alias("flags")).select("vec_id", "flags", files.pack_bits(F.col("flags")).alias("packed"))
    return rows.select("vec_id", F.array_join(F.col("packed").cast("array<string>"), " ").alias("bytes"), (files.unpack_bits(F.col("packed"), F.size("flags")) == F.col("flags")).alias("same"))


def color_limits(spark: SparkSession, d: str) -> DataFrame:
    points = _e(spark, d).select(F.col("e")[0].alias("u"), F.col("e")[1].alias("v"))
    return _six(lifting.axis_limits(points, ["u", "v"], 0.02, 0.98, 0.0), ["low", "high"])


def carried_detections(spark: SparkSession, d: str) -> DataFrame:
    s = adapters.signal(spark, d)
    out = scans.carry_sampled(s, "value", F.col("event_type") == "error", 3)
    return _six(out.select("clip_key", "frame_number", "carried"), ["carried"])


def _sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Body, full-body and hand detections of some frames each; a likelihood below 0 means no detection."""
    def part(n: int, offset: int, keep: str) -> DataFrame:
        at = lambda k: F.get("e", (k % 64).cast("int"))
        joint = lambda j: F.struct(at(j * 3 + offset).alias("x"), at(j * 3 + offset + 1).alias("y"), F.when(at(j * 3 + offset + 2) > 0, at(j * 3 + offset + 2)).alias("lik"))
        return _e(spark, d).filter(keep).select(F.col("vec_id").alias("frame_number"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), joint).alias("kp"))

    return {"body": part(17, 0, "vec_id % 5 <> 0"), "full_body": part(59, 5, "vec_id % 3 <> 0"), "hand": part(42, 11, "vec_id % 2 = 0")}


def merge_keypoints(spark: SparkSession, d: str) -> DataFrame:
    long = poses.merge_pose_sources(**_sources(spark, d)).select("frame_number", F.posexplode("kp").alias("joint", "k"))
    return _six(long.select("frame_number", "joint", "k.x", "k.y", "k.lik"), ["x", "y", "lik"])


def smooth_keypoints(spark: SparkSession, d: str) -> DataFrame:
    kp = F.transform("kp", lambda k: F.struct(k["x"].alias("x"), k["y"].alias("y"), F.when(k["lik"] >= 0.3, k["lik"]).alias("lik")))
    return _six(runs.smooth_poses(adapters.pose_2d(spark, d).withColumn("kp", kp)), ["x", "y", "lik"])


def lift_run(spark: SparkSession, d: str) -> DataFrame:
    kp = F.transform("kp", lambda k: F.struct(((k["x"] + 1) * 4).alias("x"), ((k["y"] + 1) * 4).alias("y"), k["lik"].alias("lik")))
    frames = adapters.long_pose_2d(spark, d).select(F.col("clip_key").alias("run"), F.col("frame_index").cast("int").alias("frame_index"), "frame_number", kp.alias("kp"))
    out = runs.lift_run(frames, adapters.rasters(spark, d, F.col("label")).filter("frame_number % 9 <> 0"), HANDS, (0, 1), 8, 8, block=tracks.BLOCK)
    return _six(out, ["x", "y", "z", "lik"], 5)


def full_pose(spark: SparkSession, d: str) -> DataFrame:
    """59 joints of (x, y, z, lik) a frame, from the 64 numbers of an embedding."""
    at = lambda k: F.get("e", (k % 64).cast("int"))
    joint = lambda j: F.struct(at(4 * j).alias("x"), at(4 * j + 1).alias("y"), at(4 * j + 2).alias("z"), F.least(F.lit(1.0), 8 * F.abs(at(4 * j + 3))).alias("lik"))
    place = F.row_number().over(poses.Window.partitionBy("clip_key").orderBy("vec_id")) - 1
    return _e(spark, d).withColumn("clip_key", adapters.clip_of_label()).select("clip_key", place.alias("frame_index"), F.transform(F.sequence(F.lit(0), F.lit(58)), joint).alias("kp"))


def skeleton_fit(spark: SparkSession, d: str) -> DataFrame:
    return runs.fit_run(full_pose(spark, d), *runs.full_skeleton())[0]


def skeleton_fit_report(spark: SparkSession, d: str) -> DataFrame:
    return runs.fit_run(full_pose(spark, d), *runs.full_skeleton())[1]


QUERIES = {
    f.__name__: f
    for f in (
        frame_numbers, participant_paths, reference_paths, frame_rates, run_videos, stale_cache, scan_recordings, scan_schools, whole_body_joints, hand_slots, frame_stride,
        visible_extents, pixel_extents, trail_alphas, companion_pixels, frame_mismatches, neighbour_excerpts, times_ago, depth_model_kinds, people_of_schools, preview_frames,
        depth_of_frames, sky_bits, color_limits, carried_detections, merge_keypoints, smooth_keypoints, lift_run, skeleton_fit, skeleton_fit_report,
    )
}

_E = "v AS (SELECT vec_id, label, list_transform(embedding, lambda a: a::DOUBLE) AS e FROM embeddings)"
_RECORDINGS = """r AS (SELECT 'S' || l_orderkey % 7 AS school, 'P' || l_orderkey % 50 AS participant, 'recording_' || l_orderkey || '.mp4' AS recording, l_linenumber AS k
  FROM lineitem WHERE l_orderkey % 7 <> 6)"""


def _candidate(source: str, offset: int, joint: str) -> str:
    at = lambda k: f"e[({joint} * 3 + {offset + k}) % 64 + 1]"
    here = {"body": "vec_id % 5 <> 0", "full": "vec_id % 3 <> 0", "hand": "vec_id % 2 = 0"}[source]
    return f"CASE WHEN {here} AND {at(2)} > 0 THEN {{'x': {at(0)}, 'y': {at(1)}, 'lik': {at(2)}}} END"


_WRIST = "(CASE j WHEN 17 THEN 9 ELSE 10 END)"
_LONG = """l AS (SELECT clip_key AS run, frame_index, frame_number, j AS joint, (e[3 * j + 1] + 1) * 4 AS px, (e[3 * j + 2] + 1) * 4 AS py, least(1.0, 8 * abs(e[3 * j + 3])) AS lik, e
  FROM (SELECT *, unnest(range(21)) AS j FROM p))"""

ORACLES = {
    "frame_numbers": "SELECT printf('frame_%04d', event_id) AS label, event_id::INT AS frame_number FROM events",
    "participant_paths": """SELECT o_orderkey, 'recording_' || CASE WHEN o_orderkey % 2 = 0 THEN 'P' ELSE 'p' END || o_custkey || '_task' || o_orderkey % 5 || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '__' || o_orderkey % 3 END AS clip_id,
        CASE WHEN o_orderkey % 3 = 0 THEN 'task' || o_orderkey % 5 ELSE 'task' || o_orderkey % 5 END AS category, 'P' || o_custkey AS participant_id, 'S' || o_custkey % 9 AS school FROM orders""",
    "reference_paths": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '/ref/set_IrrelevantDA' ELSE '/ref/set_relevantDA' END || '/pose_estimation/merged_predictions/results_clip_' || p_partkey || '.mp4_merged.csv' AS path,
        'clip_' || p_partkey AS clip_id, CASE WHEN p_partkey % 2 = 0 THEN 'irrelevant' ELSE 'relevant' END AS category FROM part""",
    "frame_rates": """SELECT event_id, round(CASE WHEN fps > 0.001 THEN fps ELSE 30 END, 6) AS fps FROM (
        SELECT event_id, CASE event_id % 3 WHEN 1 THEN value / 1e6::DOUBLE WHEN 2 THEN value END AS fps FROM events)""",
    "run_videos": """SELECT folder, min(CASE k WHEN 3 THEN folder || '/clip_' || l_partkey || '.mp4' ELSE folder || '/x' || l_suppkey || '.AVI' END) AS video
        FROM (SELECT '/r/' || l_orderkey AS folder, l_linenumber AS k, * FROM lineitem) WHERE k IN (3, 4) GROUP BY folder""",
    "stale_cache": "SELECT '/clips/' || c_custkey AS path, substr(sha1('/clips/' || c_custkey), 1, 20) AS key FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0",
    "scan_recordings": f"WITH {_RECORDINGS}, f AS (SELECT school, participant, recording, " + ", ".join(f"max((k = {i + 1})::INT) AS {s}" for i, s in enumerate(STAGES)) + f" FROM r GROUP BY ALL) SELECT *, {' + '.join(STAGES)} AS completed FROM f",
    "scan_schools": f"""WITH {_RECORDINGS}, n AS (SELECT school, count(DISTINCT participant) AS participants, count(DISTINCT (participant, recording)) AS recordings FROM r GROUP BY school),
        s AS (SELECT DISTINCT 'S' || CASE WHEN l_orderkey % 7 = 6 THEN l_orderkey % 21 ELSE l_orderkey % 7 END AS school FROM lineitem)
        SELECT school, coalesce(participants, 0) AS participants, coalesce(recordings, 0) AS recordings FROM s LEFT JOIN n USING (school)""",
    "whole_body_joints": f"WITH {_E}, j AS (SELECT vec_id, e, unnest(range(59)) AS joint FROM v) SELECT vec_id, joint::INT AS joint, round(e[((CASE WHEN joint < 17 THEN joint ELSE joint + 74 END) * 7) % 64 + 1], 6) + 0 AS v FROM j",
    "hand_slots": f"""WITH {_E}, j AS (SELECT vec_id, e, vec_id % 4 AS k, unnest(range(42)) AS slot FROM v)
        SELECT vec_id, slot::INT AS slot, round(CASE WHEN k = 1 AND slot < 21 THEN e[slot + 1] WHEN k = 2 THEN e[CASE WHEN slot < 21 THEN 21 + slot ELSE slot - 21 END + 1] WHEN k = 3 AND slot > 20 THEN e[slot - 20] END, 6) + 0 AS v FROM j""",
    "frame_stride": "SELECT vec_id AS frame_number FROM embeddings WHERE vec_id >= 10 AND vec_id < 400 AND (vec_id - 10) % 7 = 0",
    "visible_extents": f"""WITH {POSE}, l AS (SELECT clip_key, e[4 * j + 1] AS x, e[4 * j + 2] AS y, e[4 * j + 3] AS z, least(1.0, 8 * abs(e[4 * j + 4])) AS lik FROM (SELECT *, unnest(range(16)) AS j FROM p) WHERE j NOT IN (2, 3)),
        m AS (SELECT clip_key, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS b_y, min(z) AS az, max(z) AS bz FROM l WHERE lik >= 0.05 GROUP BY clip_key),
        h AS (SELECT *, greatest(greatest(bx - ax, b_y - ay, bz - az) / 2, 0.001) * 1.18::DOUBLE AS half FROM m)
        SELECT clip_key, """ + ", ".join(f"round(({a} + {b}) / 2 - half, 6) AS {n}_low, round(({a} + {b}) / 2 + half, 6) AS {n}_high" for n, a, b in (("x", "ax", "bx"), ("y", "ay", "b_y"), ("z", "az", "bz"))) + " FROM h",
    "pixel_extents": f"""WITH {_E}, m AS (SELECT label AS clip_key, min(e[1]) AS ax, max(e[1]) AS bx, min(e[2]) AS ay, max(e[2]) AS b_y FROM v GROUP BY label), h AS (SELECT *, greatest(bx - ax, b_y - ay) * 0.13::DOUBLE AS w FROM m)
        SELECT clip_key, round(ax - w, 6) AS x_low, round(bx + w, 6) AS x_high, round(ay - w, 6) AS y_low, round(b_y + w, 6) AS y_high FROM h""",
    "trail_alphas": f"""WITH {SIGNAL}, n AS (SELECT *, count(*) OVER (PARTITION BY clip_key) AS n FROM s)
        SELECT clip_key, frame_index, round(0.1::DOUBLE + 0.9::DOUBLE * pow((frame_index - (n - 10) // 2) / 9, 1.7), 6) AS alpha FROM n WHERE n >= 10 AND frame_index >= (n - 10) // 2 AND frame_index < (n - 10) // 2 + 10""",
    "companion_pixels": f"""WITH {POSE}, c AS (SELECT clip_key, row_number() OVER (PARTITION BY clip_key ORDER BY frame_number) - 1 AS frame_index, e, count(*) OVER (PARTITION BY clip_key) AS n FROM p WHERE clip_key % 2 = 0 OR frame_number % 10 <> 0)
        SELECT p.clip_key, frame_number, round(c.e[1], 6) + 0 AS px, round(c.e[2], 6) + 0 AS py FROM (SELECT *, count(*) OVER (PARTITION BY clip_key) AS n FROM p) p LEFT JOIN c ON c.clip_key = p.clip_key AND c.frame_index = p.frame_index AND c.n = p.n""",
    "frame_mismatches": "SELECT label * 1000000::BIGINT + vec_id // 640 AS clip_key, vec_id AS frame_number FROM embeddings WHERE (vec_id % 11 = 0) <> (vec_id % 7 = 0)",
    "neighbour_excerpts": """SELECT 'S' || c_nationkey AS school, printf('rank%02d_U%d_c%d_f%05d-%05d.mp4', event_id % 10 + 1, user_id, user_id % 3, event_id % 97, event_id % 97 + event_id % 13 + 2) AS excerpt
        FROM events JOIN customer ON c_custkey = user_id WHERE c_custkey % 2 = 0""",
    "times_ago": """WITH t AS (SELECT event_id, floor(event_id * 1.5::DOUBLE + 0.5)::BIGINT AS s FROM events), u AS (SELECT *, floor(s / 60.0::DOUBLE + 0.5)::BIGINT AS m FROM t)
        SELECT event_id, CASE WHEN s < 5 THEN 'just now' WHEN s < 60 THEN s || 's ago' WHEN m < 60 THEN m || 'm ago' ELSE floor(m / 60.0::DOUBLE + 0.5)::BIGINT || 'h ago' END AS ago FROM u""",
    "depth_model_kinds": "SELECT p_partkey, p_partkey % 4 = 0 AS is_metric_only, p_partkey % 4 IN (1, 3) AS cross_view FROM part",
    "people_of_schools": "SELECT n_name AS school, c_custkey AS participant, o_orderkey AS recording FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name IN ('NATION_1', 'NATION_3') AND c_custkey % 3 = 0 AND c_custkey < 150",
    "preview_frames": "SELECT vec_id AS frame_number, label * 1000000::BIGINT + vec_id // 640 AS clip_key FROM embeddings ORDER BY vec_id LIMIT 60",
    "depth_of_frames": "SELECT vec_id AS frame_number, CASE WHEN vec_id % 4 <> 0 THEN vec_id % 3 = 0 END AS is_metric, round(CASE WHEN vec_id % 4 <> 0 THEN abs(embedding[1]::DOUBLE) * 600 / 300 END, 6) + 0 AS metres FROM embeddings",
    "sky_bits": "SELECT vec_id, array_to_string(list_transform(range(8), lambda i: list_sum(list_transform(range(8), lambda b: CASE WHEN embedding[i * 8 + b + 1] > 0 THEN 128 >> b::INT ELSE 0 END))::INT), ' ') AS bytes, true AS same FROM embeddings",
    "color_limits": "SELECT axis, round(lo, 6) + 0 AS low, round(hi, 6) + 0 AS high FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS axis, quantile_cont(embedding[{i}]::DOUBLE, 0.02) AS lo, quantile_cont(embedding[{i}]::DOUBLE, 0.98) AS hi FROM embeddings" for a, i in (("u", 1), ("v", 2))) + ")",
    "carried_detections": f"""WITH {SIGNAL} SELECT clip_key, frame_number, round(last_value(CASE WHEN frame_index % 3 = 0 THEN {{'v': CASE WHEN event_type <> 'error' THEN value END}} END IGNORE NULLS)
        OVER (PARTITION BY clip_key ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW).v, 6) AS carried FROM s""",
    "merge_keypoints": f"""WITH {_E}, l AS (SELECT *, unnest(range(59)) AS j FROM v WHERE vec_id % 5 <> 0 OR vec_id % 3 <> 0 OR vec_id % 2 = 0),
        k AS (SELECT vec_id, j, CASE WHEN j < 17 THEN coalesce({_candidate("body", 0, "j")}, {_candidate("full", 5, "j")})
            WHEN j IN (17, 38) THEN coalesce({_candidate("body", 0, _WRIST)}, {_candidate("full", 5, "j")}, {_candidate("full", 5, _WRIST)})
            ELSE coalesce({_candidate("hand", 11, "(j - 17)")}, {_candidate("full", 5, "j")}) END AS p FROM l)
        SELECT vec_id AS frame_number, j::INT AS joint, round(p.x, 6) + 0 AS x, round(p.y, 6) + 0 AS y, round(p.lik, 6) + 0 AS lik FROM k""",
    "smooth_keypoints": f"""WITH {POSE}, l AS (SELECT clip_key, frame_index, frame_number, j, e[3 * j + 1] AS x, e[3 * j + 2] AS y, CASE WHEN least(1.0, 8 * abs(e[3 * j + 3])) >= 0.3 THEN least(1.0, 8 * abs(e[3 * j + 3])) END AS lik FROM (SELECT *, unnest(range(21)) AS j FROM p))
        SELECT clip_key, frame_number, j::INT AS joint, """ + ", ".join(f"round(CASE WHEN lik IS NULL THEN {a} ELSE quantile_cont(CASE WHEN lik IS NOT NULL THEN {a} END, 0.5) OVER w END, 6) + 0 AS {a}" for a in "xy") + ", round(lik, 6) + 0 AS lik FROM l WINDOW w AS (PARTITION BY clip_key, j ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "lift_run": f"""WITH {POSE_LONG}, {_LONG}, d AS (SELECT * EXCLUDE (e), CASE WHEN frame_number % 9 <> 0 THEN {_bilinear("px", "py")} END AS raw FROM l),
        c AS (SELECT run, sqrt((b.px - a.px) ** 2 + (b.py - a.py) ** 2) * (a.raw + b.raw) / 2 AS m, sqrt((b.px - a.px) ** 2 + (b.py - a.py) ** 2) AS n
          FROM (SELECT * FROM d WHERE joint = 0) a JOIN (SELECT * FROM d WHERE joint = 1) b USING (run, frame_index) WHERE a.lik >= 0.5 AND b.lik >= 0.5 AND a.raw > 0 AND b.raw > 0),
        k AS (SELECT run, 0.4::DOUBLE * 8 / median(m) AS scale FROM c WHERE n >= 0.001 GROUP BY run),
        z AS (SELECT run, frame_index, joint, px, py, lik, raw * coalesce(scale, 1) AS z, CASE WHEN joint IN (6, 8, 9, 10, 11, 12) THEN 0 WHEN joint IN (7, 13, 14, 15, 16, 17) THEN 1 END AS hand FROM d LEFT JOIN k USING (run)),
        h AS (SELECT run, frame_index, hand, count(*) AS n, median((px - 4) * z / 8) AS mx, median((py - 4) * z / 8) AS my, median(z) AS mz FROM z WHERE hand IS NOT NULL AND z IS NOT NULL AND lik >= 0.05 GROUP BY ALL),
        f AS (SELECT z.*, coalesce(z.z IS NOT NULL AND lik >= 0.05 AND n >= 2 AND joint NOT IN (6, 7) AND sqrt(((px - 4) * z / 8 - mx) ** 2 + ((py - 4) * z / 8 - my) ** 2 + (z - mz) ** 2) > 0.15, false) AS bad FROM z LEFT JOIN h USING (run, frame_index, hand)),
        g AS (SELECT *, last_value(CASE WHEN z IS NOT NULL AND NOT bad THEN {{'i': frame_index, 'v': z}} END IGNORE NULLS) OVER (PARTITION BY run, joint ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
                     first_value(CASE WHEN z IS NOT NULL AND NOT bad THEN {{'i': frame_index, 'v': z}} END IGNORE NULLS) OVER (PARTITION BY run, joint ORDER BY frame_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM f),
        i AS (SELECT * REPLACE (CASE WHEN bad THEN a.v + (b.v - a.v) * (frame_index - a.i) / (b.i - a.i) ELSE z END AS z) FROM g),
        s AS (SELECT * REPLACE (CASE WHEN z IS NOT NULL THEN quantile_cont(z, 0.5) OVER (PARTITION BY run, joint ORDER BY frame_index ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) END AS z) FROM i)
        SELECT run, frame_index::INT AS frame_index, joint::INT AS joint, round((px - 4) * z / 8, 5) + 0 AS x, round((py - 4) * z / 8, 5) + 0 AS y, round(z, 5) + 0 AS z, round(lik, 5) + 0 AS lik FROM s""",
}
