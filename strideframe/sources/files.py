"""Recordings in folders: pose tables with four header rows, listings and their metadata.

Tables are read as text, which Spark splits by size, and parsed by expressions; so is what a path says about its clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.expr import finite
from strideframe.functions.skeleton import BODYPARTS
from strideframe.operators import scans
from strideframe.sources.depth import read_archives

DEFAULT_FPS = 30.0
# The file of each stage of a recording, with {run} for its folder's name, and the head of a compressed depth file.
STAGE_FILES = {
    "body": "results_{run}_body.csv", "full_body": "results_{run}_full_body.csv", "hand": "results_{run}_hand.csv", "merged": "results_{run}_merged.csv",
    "depth": "depth_{run}.npz", "pose_3d": "results_{run}_3d.csv", "fitted": "results_{run}_3d_fitted.csv",
}
# The first cell of each header row.
HEADS = ["scorer", "individuals", "bodyparts", "coords"]
AXES_OF = {2: ("x", "y", "lik"), 3: ("x", "y", "z", "lik")}
#: Parts in which the rows of one file meet its head.
SALTS = 32
read_depth = read_archives


def frame_number(label: Column) -> Column:
    """The number after the last underscore of a frame's label; a label without one raises."""
    digits = F.regexp_extract(label, r"_([0-9]+)$", 1)
    return F.when(digits != "", digits.cast("int")).otherwise(F.raise_error(F.concat(F.lit("Unexpected frame label: "), label)).cast("int"))


def _number(text: Column) -> Column:
    """A finite number, or nothing."""
    return finite(text.try_cast("double"))


def _columns_of(parts: Column, coords: Column, dims: int, bodyparts: list[str]) -> Column:
    """Of each joint and coordinate the places of its columns, in the file's order."""
    names = {"x": "x", "y": "y", "z": "z", "lik": "likelihood"}
    at = F.sequence(F.lit(1), F.size(parts) - 1)
    of = lambda joint, c: F.filter(at, lambda i: (F.get(parts, i) == joint) & (F.get(coords, i) == c))
    return F.transform(F.array(*map(F.lit, bodyparts)), lambda joint: F.struct(*[of(joint, names[a]).alias(a) for a in AXES_OF[dims]]))


def pose_heads(lines: DataFrame, dims: int = 2, bodyparts: list[str] = BODYPARTS) -> DataFrame:
    """path and ``slots`` (where each joint's coordinates stand) of every file, from its header rows."""
    kind = lambda k: F.max(F.when(F.substring_index("value", ",", 1) == k, F.col("value")))
    heads = lines.filter(F.substring_index("value", ",", 1).isin(HEADS)).groupBy("path").agg(kind("bodyparts").alias("b"), kind("coords").alias("c"))
    return heads.select("path", _columns_of(F.split("b", ","), F.split("c", ","), dims, bodyparts).alias("slots"))


def pose_rows(lines: DataFrame, heads: DataFrame, dims: int = 2) -> DataFrame:
    """path, frame_number and kp of the lines (path, value) that are no header rows. Scorers and individuals collapse to the first
    present value of each joint and coordinate; joints that are absent are missing. Rows of a file meet its head in SALTS parts, so one large
    file is no single task."""
    salt = F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")
    rows = lines.filter(~F.substring_index("value", ",", 1).isin(HEADS)).withColumn("_salt", salt)
    spread = heads.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.join(spread, ["path", "_salt"]).select("path", F.split("value", ",").alias("cells"), "slots")
    first = lambda places: F.get(F.filter(F.transform(places, lambda i: _number(F.get(F.col("cells"), i))), lambda v: v.isNotNull()), 0)
    kp = F.transform("slots", lambda s: F.struct(*[first(s[a]).alias(a) for a in AXES_OF[dims]]))
    return met.select("path", frame_number(F.get("cells", 0)).alias("frame_number"), kp.alias("kp"))


def _lines(text: DataFrame) -> DataFrame:
    """path (as listings write it) and value of the lines that are not empty."""
    path = F.regexp_replace("_metadata.file_path", "^file:///", "file:/")
    return text.select(path.alias("path"), F.regexp_replace("value", "\r$", "").alias("value")).filter("value <> ''")


def read_pose_csv(spark: SparkSession, path: str | list[str], dims: int = 2, bodyparts: list[str] = BODYPARTS) -> DataFrame:
    """path, frame_index (by frame number, from 0), frame_number and kp of every row of the pose tables at ``path`` (globs too). Files are
    read line by line in as many tasks as their sizes ask for, and numbered in ranges of frames."""
    lines = _lines(spark.read.text(path))
    rows = pose_rows(lines, pose_heads(lines, dims, bodyparts), dims)
    placed = scans.numbered(rows, "path", F.floor(F.col("frame_number") / scans.BLOCK), ["frame_number"])
    return placed.select("path", F.col("frame_index").cast("int").alias("frame_index"), "frame_number", "kp")


def stream_pose_csv(spark: SparkSession, folder: str, like: str, dims: int = 2, files_a_batch: int = 1000, glob: str = "*", bodyparts: list[str] = BODYPARTS) -> DataFrame:
    """The rows (path, frame_number, kp) of pose tables as they arrive below ``folder``, all with the columns of the file ``like``."""
    slots = pose_heads(_lines(spark.read.text(like)), dims, bodyparts).drop("path")
    text = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).text(folder)
    lines = _lines(text)
    rows = lines.filter(~F.substring_index("value", ",", 1).isin(HEADS)).crossJoin(F.broadcast(slots))  # one row
    first = lambda places: F.get(F.filter(F.transform(places, lambda i: _number(F.get(F.col("cells"), i))), lambda v: v.isNotNull()), 0)
    kp = F.transform("slots", lambda s: F.struct(*[first(s[a]).alias(a) for a in AXES_OF[dims]]))
    return rows.select("path", F.split("value", ",").alias("cells"), "slots").select("path", frame_number(F.get("cells", 0)).alias("frame_number"), kp.alias("kp"))


def write_pose_csv(frames: DataFrame, path: str, scorer: str, dims: int = 2, bodyparts: list[str] = BODYPARTS) -> None:
    """Pose tables in folders ``clip_key=...``, one file a clip: four header rows, then frames by number. ``frames``
    has clip_key, frame_number and kp."""
    axes, coords = (["x", "y", "z", "lik"], ["x", "y", "z", "likelihood"]) if dims == 3 else (["x", "y", "lik"], ["x", "y", "likelihood"])
    columns = [(scorer, "idv_0", p, c) for p in bodyparts for c in coords]
    heads = [",".join([name, *(c[i] for c in columns)]) for i, name in enumerate(("scorer", "individuals", "bodyparts", "coords"))]
    cell = lambda c: F.when(c.isNull() | F.isnan(c), "").otherwise(c.cast("string"))
    values = F.concat_ws(",", F.transform("kp", lambda k: F.concat_ws(",", *[cell(k[a]) for a in axes])))
    lines = frames.select("clip_key", F.col("frame_number").alias("n"), F.concat_ws(",", F.format_string("frame_%04d", "frame_number"), values).alias("value"))
    top = F.explode(F.array(*[F.struct(F.lit(i - 4).alias("n"), F.lit(h).alias("value")) for i, h in enumerate(heads)]))
    first = frames.select("clip_key").distinct().select("clip_key", top.alias("h")).select("clip_key", "h.n", "h.value")
    every = lines.unionByName(first)
    every.repartition("clip_key").sortWithinPartitions("clip_key", "n").select("clip_key", "value").write.partitionBy("clip_key").text(path)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modificationTime of every file below a folder; the contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def _part(path: Column, back: int) -> Column:
    """The part of a path that stands ``back`` places before its last one."""
    return F.element_at(F.split(path, "/"), -1 - back)


def participant_meta(path: Column) -> dict[str, Column]:
    """What .../school/participant/recording_<participant>_<task>[__n].mp4/file says."""
    participant, recording = _part(path, 2), F.regexp_replace(_part(path, 1), r"\.mp4$", "")
    prefix = F.concat(F.lit("recording_"), participant, F.lit("_"))
    task = F.when(F.lower(recording).startswith(F.lower(prefix)), F.substr(recording, F.length(prefix) + 1)).otherwise(recording)
    return {"clip_id": recording, "category": F.regexp_replace(task, r"__?[0-9]+$", ""), "participant_id": participant, "school": _part(path, 3)}


def reference_meta(path: Column) -> dict[str, Column]:
    """What .../<category folder>/pose_estimation/merged_predictions/results_<clip>_merged.csv says."""
    clip = F.regexp_replace(F.regexp_replace(F.regexp_replace(_part(path, 0), r"^results_", ""), r"_merged\.csv$", ""), r"\.mp4$", "")
    return {"clip_id": clip, "category": F.when(F.lower(_part(path, 3)).contains("irrelevant"), "irrelevant").otherwise("relevant")}


def load_dataset(spark: SparkSession, participants: str, references: str, fps: DataFrame | None = None, dims: int = 2) -> DataFrame:
    """Frames of the pose tables of participants and references (globs), with what their paths say and ``is_reference``.
    ``fps``: path and fps where the frame rate of a clip's video is known."""
    path = F.col("path")
    mine = read_pose_csv(spark, participants, dims).select("*", F.lit(False).alias("is_reference"), *[c.alias(n) for n, c in participant_meta(path).items()])
    theirs = read_pose_csv(spark, references, dims).select("*", F.lit(True).alias("is_reference"), *[c.alias(n) for n, c in reference_meta(path).items()])
    every = mine.unionByName(theirs, allowMissingColumns=True)
    rates = every.withColumn("fps", F.lit(None).cast("double")) if fps is None else every.join(fps.select("path", "fps"), "path", "left")
    return rates.withColumn("fps", fps_or_default(F.col("fps"))).withColumn("clip_key", F.xxhash64("path"))


def is_participant_csv(path: Column) -> Column:
    return path.rlike(r"/recording_[^/]*\.mp4/results_[^/]*_merged\.csv$")


def is_reference_csv(path: Column) -> Column:
    return path.rlike(r"/pose_estimation/merged_predictions/results_[^/]*_merged\.csv$")


def companion_2d(path: Column) -> Column:
    """The merged 2D table that belongs to a 3D one."""
    return F.regexp_replace(F.regexp_replace(path, "/pose_3d_predictions/", "/merged_predictions/"), r"_3d(_fitted)?\.csv$", "_merged.csv")


def fps_or_default(fps: Column) -> Column:
    """Frame rates that are missing or next to 0 count as 30."""
    return F.when((fps > 1e-3) & ~F.isnan(fps), fps).otherwise(DEFAULT_FPS)


def first_videos(files: DataFrame, rule: str = "made") -> DataFrame:
    """folder and its first video by name. Left out are by ``rule`` "made": what the pipeline made (by the beginning of names); "drawn": drawings
    only; "run": videos whose name contains the folder's name."""
    file, run = _part(F.col("path"), 0), _part(F.col("path"), 1)
    rules = {"made": ~F.lower(file).rlike(r"^(visualization_|results_|bboxes_)"), "drawn": ~file.startswith("visualization_"), "run": ~file.contains(run)}
    mine = F.lower(file).rlike(r"\.(mp4|avi)$") & rules[rule]
    return files.filter(mine).groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).agg(F.min("path").alias("video"))


def cache_key(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 20)


def stale_clips(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files (path, modificationTime) that the cache (key, source_mtime) lacks or holds from another time."""
    keyed = files.withColumn("key", cache_key(F.col("path")))
    return keyed.join(cached, (keyed["key"] == cached["key"]) & (keyed["modificationTime"] == cached["source_mtime"]), "left_anti")


def scan_recordings(files: DataFrame) -> DataFrame:
    """school, participant, recording, one flag a stage and ``completed``, from a listing of .../school/participant/recording/file."""
    p = F.col("path")
    run = _part(p, 1)
    rows = files.filter(run.rlike(r"^recording_.*\.mp4$")).select(_part(p, 3).alias("school"), _part(p, 2).alias("participant"), run.alias("recording"), _part(p, 0).alias("file"))
    stages = []
    for stage, pattern in STAGE_FILES.items():
        before, after = pattern.split("{run}")
        stages.append(F.max(F.when(F.col("file") == F.concat(F.lit(before), F.col("recording"), F.lit(after)), 1).otherwise(0)).alias(stage))
    found = rows.groupBy("school", "participant", "recording").agg(*stages)
    return found.withColumn("completed", sum((F.col(s) for s in list(STAGE_FILES)[1:]), F.col("body"))).orderBy("school", "participant", "recording")


def scan_schools(files: DataFrame, folder_depth: int) -> DataFrame:
    """school, participants and recordings of every school folder with a file in it, also of those without recordings.
    ``folder_depth``: parts of a path up to the school."""
    rows = files.select(F.element_at(F.split("path", "/"), folder_depth).alias("school")).distinct()
    n = scan_recordings(files).groupBy("school").agg(F.count_distinct("participant").alias("participants"), F.count("*").alias("recordings"))
    return rows.join(n, "school", "left").na.fill(0).orderBy("school")


def snapshot(recordings: DataFrame) -> DataFrame:
    """The recordings nested by participant and school, each level in the order of names."""
    stages = F.struct(*[F.col(s) for s in STAGE_FILES])
    people = recordings.groupBy("school", "participant").agg(F.sort_array(F.collect_list(F.struct(F.col("recording").alias("name"), stages.alias("stages"), "completed"))).alias("recordings"))
    return people.groupBy("school").agg(F.sort_array(F.collect_list(F.struct(F.col("participant").alias("name"), "recordings"))).alias("participants")).orderBy("school")


def pack_bits(flags: Column) -> Column:
    """Booleans as bytes (0 to 255), eight to a byte, the first in the highest bit; the last byte is filled with zeros."""
    n = F.ceil(F.size(flags) / 8).cast("int")
    byte = lambda i: F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.when(F.coalesce(F.get(flags, i * 8 + b), F.lit(False)), F.element_at(F.array(*[F.lit(128 >> k) for k in range(8)]), b + 1)).otherwise(0)),
        F.lit(0), lambda a, x: a + x,
    )
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), byte)).otherwise(F.array().cast("array<int>"))


def unpack_bits(packed: Column, n: Column) -> Column:
    """The first ``n`` booleans of packed bytes."""
    bit = lambda i: F.get(packed, F.floor(i / 8).cast("int")).bitwiseAND(F.element_at(F.array(*[F.lit(128 >> k) for k in range(8)]), (i % 8).cast("int") + 1)) > 0
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), bit)).otherwise(F.array().cast("array<boolean>"))


def read_person_frames(spark: SparkSession, path: str) -> DataFrame:
    """frame and persons (arrays of [x, y, ..., score]) of JSON lists of frames."""
    schema = "frame long, persons array<struct<keypoints:array<array<double>>>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select("frame", F.transform("persons", lambda p: p["keypoints"]).alias("persons"))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """A settings file as one row; a dotted name such as ``a.b`` selects a value."""
    return spark.read.option("multiLine", "true").json(path)


def read_boxes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, frame_number, boxes ([x, y, width, height] each) and hand_labels of box tables: CSV files whose cells hold lists."""
    schema = "frame_label string, bboxes string, hand_labels string"
    rows = spark.read.schema(schema).option("header", "true").option("quote", '"').option("escape", '"').csv(path)
    boxes = F.from_json(F.regexp_replace("bboxes", "nan", "null"), "array<array<double>>")
    labels = F.from_json(F.regexp_replace("hand_labels", "'", '"'), "array<string>")
    at = F.regexp_replace("_metadata.file_path", "^file:///", "file:/")
    return rows.select(at.alias("path"), frame_number(F.col("frame_label")).alias("frame_number"), boxes.alias("boxes"), labels.alias("hand_labels"))


def write_boxes(frames: DataFrame, path: str) -> None:
    """Box tables in folders ``clip_key=...``: frame_label, bboxes and hand_labels of ``frames`` (clip_key, frame_number, boxes, hand_labels), by frame."""
    of = lambda c, inner: F.concat(F.lit("["), F.array_join(F.transform(c, inner), ", "), F.lit("]"))
    boxes = of("boxes", lambda b: F.concat(F.lit("["), F.array_join(F.transform(b, lambda v: v.cast("string")), ", "), F.lit("]")))
    labels = of("hand_labels", lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    rows = frames.select("clip_key", F.col("frame_number").alias("_n"), F.format_string("frame_%04d", "frame_number").alias("frame_label"), boxes.alias("bboxes"), labels.alias("hand_labels"))
    ordered = rows.repartitionByRange("clip_key", "_n").sortWithinPartitions("clip_key", "_n").drop("_n")
    ordered.write.partitionBy("clip_key").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


#: The view of the sweep, in degrees.
SWEEP_STEP, SWEEP_ELEVATION = 36, 0


def selections(middle: DataFrame, videos: DataFrame) -> DataFrame:
    """clip_key, ``selection`` and ``angle_sweep`` (JSON): the middle frames of each clip as its artwork takes them. ``middle``: clip_key, frame_index,
    frame_number and is_middle (ten rows a clip); ``videos``: clip_key, video, pose_2d_csv, pose_3d_csv."""
    rows = middle.groupBy("clip_key").agg(F.array_sort(F.collect_list(F.struct("frame_index", "frame_number"))).alias("r"), F.max(F.when(F.col("is_middle"), F.col("frame_number"))).alias("m"))
    selection = F.to_json(F.struct("video", "pose_2d_csv", "pose_3d_csv", F.col("r.frame_index").alias("prediction_rows"), F.col("r.frame_number").alias("video_frames"), F.col("m").alias("middle_video_frame")))
    angles = F.sequence(F.lit(0), F.lit(360 - SWEEP_STEP), F.lit(SWEEP_STEP))
    sweep = F.to_json(F.struct(F.col("m").alias("frame"), F.lit(SWEEP_ELEVATION).alias("elevation_degrees"), angles.alias("azimuth_degrees")))
    return rows.join(videos, "clip_key", "left").select("clip_key", selection.alias("selection"), sweep.alias("angle_sweep"))
