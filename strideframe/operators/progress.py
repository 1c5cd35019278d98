"""Progress of recordings through the processing stages, and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.operators import scans

# The stages of a recording, in order.
STAGES = ["body", "full_body", "hand", "merged", "depth", "pose_3d", "fitted"]


def stage_counts(recordings: DataFrame, flags: list[str]) -> DataFrame:
    """The recordings with ``completed``, the number of finished stages."""
    return recordings.withColumn("completed", sum((F.col(f) for f in flags[1:]), F.col(flags[0])))


def rollup(recordings: DataFrame, flags: list[str]) -> DataFrame:
    """Totals for each participant, each school and all: recordings, those with every stage, and each stage."""
    done = F.when(sum((F.col(f) for f in flags[1:]), F.col(flags[0])) == len(flags), 1).otherwise(0)
    total = F.count("*")
    return recordings.rollup("school", "participant").agg(
        F.grouping_id().cast("int").alias("level"), total.alias("recordings"), F.sum(done).alias("fully_complete"),
        (100.0 * F.sum(done) / F.greatest(total, F.lit(1))).alias("percent_complete"), *[F.sum(f).alias(f"{f}_done") for f in flags],
    )


def totals(recordings: DataFrame) -> DataFrame:
    return recordings.agg(
        F.count_distinct("school").alias("schools"), F.count_distinct("school", "participant").alias("participants"), F.count("*").alias("recordings")
    )


def filter_recordings(recordings: DataFrame, flags: list[str], search: str | None = None, status: str | None = None, missing: str | None = None) -> DataFrame:
    """The monitor's filters: a substring of school, participant and recording; complete or incomplete; a missing stage."""
    out = stage_counts(recordings, flags)
    if search:
        out = out.filter(F.lower(F.concat_ws(" ", "school", "participant", "recording")).contains(search.lower()))
    if status:
        whole = F.col("completed") == len(flags)
        out = out.filter(whole if status == "complete" else ~whole)
    return out.filter(F.col(missing) == 0) if missing else out


def reference_ids(clips: DataFrame) -> DataFrame:
    """clip_id, category and a number from 1 in the order of category and clip_id."""
    refs = clips.filter("is_reference").select("category", "clip_id").distinct()
    return scans.ranked(refs, ["category", "clip_id"], "reference_number")


def participant_shades(people: DataFrame) -> DataFrame:
    """Each participant's hue (of its school) and lightness (by its place in the school)."""
    at = F.percent_rank().over(Window.partitionBy("school").orderBy("participant"))
    n = F.count("*").over(Window.partitionBy("school"))
    schools = people.select("school").distinct().withColumn("hue", (F.dense_rank().over(Window.orderBy("school")) - 1) % 6)  # schools only
    shade = F.when(n == 1, 0.5).otherwise(at)
    return people.join(F.broadcast(schools), "school").select("school", "participant", "hue", (0.30 + shade * 0.42).alias("lightness"))


def stale(wanted: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """What has no output yet."""
    return wanted.join(outputs, keys, "left_anti")


def unknown_references(requested: DataFrame, clips: DataFrame) -> DataFrame:
    """Requested ids that no reference clip has."""
    return requested.join(clips.filter("is_reference").select("clip_id").distinct(), "clip_id", "left_anti")


def require_known(requested: DataFrame, clips: DataFrame) -> None:
    missing = [r["clip_id"] for r in unknown_references(requested, clips).orderBy("clip_id").limit(20).collect()]
    if missing:
        raise ValueError(f"unknown reference ids: {', '.join(missing)}")


def seconds_ago(seconds: Column) -> Column:
    """How long ago, in words: seconds, minutes or hours, rounded half up."""
    s = F.greatest(F.lit(0), F.floor(seconds + 0.5)).cast("long")
    minutes, hours = F.floor(s / 60.0 + 0.5), F.floor(F.floor(s / 60.0 + 0.5) / 60.0 + 0.5)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.when(s < 5, "just now").when(s < 60, text(s, "s ago")).when(minutes < 60, text(minutes, "m ago")).otherwise(text(hours, "h ago"))


def model_kinds(name: Column) -> dict[str, Column]:
    """Of a depth model's name: whether its output needs scaling to metres, and whether it looks at frames together."""
    short = F.lower(F.element_at(F.split(F.regexp_replace(name, "/+$", ""), "/"), -1))
    metric_only = short.contains("metric") & ~short.contains("nested")
    return {"is_metric_only": metric_only, "cross_view": ~(short.contains("mono") | metric_only)}


def excerpt_name(rank: Column, participant: Column, clip: Column, first: Column, last: Column) -> Column:
    """The file name of an excerpt: neighbours count rows and end before ``last``, matches count frame numbers and end with it."""
    return F.format_string("rank%02d_%s_%s_f%05d-%05d.mp4", rank, participant, clip, first, last)


def match_excerpts(matches: DataFrame) -> DataFrame:
    """Matches (rank, participant_id, clip_id, start_frame, end_frame; frame numbers, the last one included) with the name of their excerpt."""
    return matches.withColumn("excerpt", excerpt_name(F.col("rank"), F.col("participant_id"), F.col("clip_id"), F.col("start_frame"), F.col("end_frame")))


def neighbour_clips(neighbours: DataFrame, clips: DataFrame) -> DataFrame:
    """Neighbours (rank, participant_id, clip_id, window_start_frame, n_frames) with their clips' other columns and the
    name of their excerpt; those whose clip is not there are left out."""
    end = F.col("window_start_frame") + F.col("n_frames")
    name = excerpt_name(F.col("rank"), F.col("participant_id"), F.col("clip_id"), F.col("window_start_frame"), end)
    return neighbours.join(clips, ["participant_id", "clip_id"]).withColumn("excerpt", name)


def select_people(recordings: DataFrame, schools: list[str] | None = None, participants: list[str] | None = None) -> DataFrame:
    """The recordings of some schools and participants; None means all."""
    out = recordings if schools is None else recordings.filter(F.col("school").isin(schools))
    return out if participants is None else out.filter(F.col("participant").isin(participants))
