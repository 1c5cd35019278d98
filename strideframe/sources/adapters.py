"""The driver's tables seen as motion data: poses, depth rasters, signals and a recording hierarchy.

Only these adapters know the tables; the operators take clips and frames of any origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideframe.operators import scans

FPS = 30.0
REFERENCE_LABELS = 3
#: A label's vectors with ids of one range are a clip: about a tenth as many frames, however large the table is.
CLIP_IDS = 640


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clip_part() -> Column:
    return F.floor(F.col("vec_id") / CLIP_IDS)


def clip_of_label() -> Column:
    return F.col("label") * F.lit(1_000_000).cast("long") + clip_part()


def _frames(spark: SparkSession, sf_dir: str, slots: list) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("clip_key").orderBy("vec_id")) - 1
    return (
        _read(spark, sf_dir, "embeddings")
        .select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e"), clip_of_label().alias("clip_key"))
        .select(
            "clip_key", F.format_string("clip_%02d_%06d", "label", clip_part()).alias("clip_id"),
            place.alias("frame_index"), F.col("vec_id").alias("frame_number"), F.lit(FPS).alias("fps"),
            (F.col("label") < REFERENCE_LABELS).alias("is_reference"),
            F.when(F.col("label") % 2 == 0, "relevant").otherwise("irrelevant").alias("category"),
            F.array(*slots).alias("kp"),
        )
    )


def _lik(i: int) -> Column:
    return F.least(F.lit(1.0), 8 * F.abs(F.col("e")[i]))


def pose_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 joints of (x, y, lik) a frame; a clip is a label's vectors of one range of ids."""
    return _frames(spark, sf_dir, _joints_2d())


def _joints_2d() -> list[Column]:
    e = F.col("e")
    return [F.struct(e[3 * j].alias("x"), e[3 * j + 1].alias("y"), _lik(3 * j + 2).alias("lik")) for j in range(21)]


def _joints_3d() -> list[Column]:
    e = F.col("e")
    return [F.struct(e[4 * j].alias("x"), e[4 * j + 1].alias("y"), e[4 * j + 2].alias("z"), _lik(4 * j + 3).alias("lik")) for j in range(16)]


def _long_frames(spark: SparkSession, sf_dir: str, slots: list) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_key"), F.col("vec_id").alias("frame_number"), F.col("embedding").cast("array<double>").alias("e"))
    frames = rows.select("clip_key", "frame_number", F.lit(FPS).alias("fps"), F.array(*slots).alias("kp"))
    return scans.numbered(frames, "clip_key", F.floor(F.col("frame_number") / CLIP_IDS), ["frame_number"])


def long_pose_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames with all of a label as one clip, as long as the table is."""
    return _long_frames(spark, sf_dir, _joints_2d())


def pose_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 joints of (x, y, z, lik) a frame."""
    return _frames(spark, sf_dir, _joints_3d())


def long_pose_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames with all of a label as one clip, as long as the table is."""
    return _long_frames(spark, sf_dir, _joints_3d())


def rasters(spark: SparkSession, sf_dir: str, run: Column | None = None) -> DataFrame:
    """8 x 8 depth images, row-major. ``run`` is by default the clip of ``pose_2d``."""
    return _read(spark, sf_dir, "embeddings").select(
        (clip_of_label() if run is None else run).alias("run"), F.col("vec_id").alias("frame_number"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.transform(F.col("embedding").cast("array<double>"), F.abs).alias("depth"),
    )


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values of a user in time order: one channel of a clip. Frames are numbered day by day, so a user of very many events is
    no single task."""
    rows = _read(spark, sf_dir, "events").withColumn("clip_key", F.col("user_id"))
    rows = scans.numbered(rows, "clip_key", F.unix_date(F.col("ts").cast("date")).cast("long"), ["ts", "event_id"])
    return rows.select(
        "clip_key", F.format_string("user_%05d", "user_id").alias("clip_id"), F.col("frame_index").cast("int").alias("frame_index"),
        F.col("event_id").alias("frame_number"), F.lit(FPS).alias("fps"), (F.col("user_id") % 10 == 0).alias("is_reference"),
        F.when(F.col("user_id") % 20 == 0, "relevant").otherwise("irrelevant").alias("category"), "event_type", "value",
    )


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """School, participant, recording and seven stage flags, one row a recording."""
    stages = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        *[F.max(F.when(F.col("l_linenumber") == k, 1).otherwise(0)).alias(f"s{k}") for k in range(1, 8)]
    )
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    people = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    schools = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        orders.join(people, orders["o_custkey"] == people["c_custkey"]).join(schools, people["c_nationkey"] == schools["n_nationkey"])
        .join(stages, orders["o_orderkey"] == stages["l_orderkey"], "left")
        .select(
            F.col("n_name").alias("school"), F.col("c_custkey").alias("participant"), F.col("o_orderkey").alias("recording"),
            *[F.coalesce(F.col(f"s{k}"), F.lit(0)).alias(f"s{k}") for k in range(1, 8)],
        )
    )
