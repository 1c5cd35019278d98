"""Tables of the analyses as they are handed out: named CSV tables with fixed columns, one folder a reference where there is one.

Files are written by Spark's own writer: a job that fails leaves no rows, rows keep their order over the part files, and a
reference's rows lie in its folder.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strideframe.functions.skeleton import feature_names, signal_names

# The columns of each table, in their order.
WINDOW = ["clip_id", "participant_id", "school", "category", "is_reference", "window_index", "window_start_frame", "n_frames"]
COLUMNS = {
    "reference_length_table": ["clip_id", "category", "n_frames", "fps", "duration_s", "diff_from_mean_frames", "diff_from_mean_s"],
    "kinematic_features_raw": [*WINDOW, "{features}"],
    "kinematic_features_normalized": [*WINDOW, "{features}"],
    "neighbors": [*WINDOW, "{features}", "tsne_distance", "rank"],
    "matches": ["rank", "clip_id", "participant_id", "school", "start_frame", "end_frame", "window_length_frames", "normalized_cost"],
    "kinematic_timeseries": ["frame", "time_s", "{signals}"],
}
#: The order of rows, and whether a reference has a folder of its own.
ORDER = {
    "reference_length_table": (["category", "clip_id"], False), "kinematic_features_raw": (["is_reference desc", "clip_id", "window_index"], False),
    "kinematic_features_normalized": (["is_reference desc", "clip_id", "window_index"], False), "neighbors": (["rank"], True), "matches": (["rank"], True),
    "kinematic_timeseries": (["frame"], True),
}


def columns_of(table: str, dims: int = 2) -> list[str]:
    out: list[str] = []
    for c in COLUMNS[table]:
        out += feature_names(dims) if c == "{features}" else signal_names(dims) if c == "{signals}" else [c]
    return out


def write_table(rows: DataFrame, folder: str, table: str, dims: int = 2, mode: str = "errorifexists") -> None:
    """Writes ``rows`` as ``table`` below ``folder``. Columns the table does not have are left out; one that is missing raises, but for
    school and participant_id, which references lack. Tables of one reference need reference_id."""
    names, (order, of_reference) = columns_of(table, dims), ORDER[table]
    optional = {"school", "participant_id"}
    missing = [c for c in [*names, *["reference_id"] * of_reference] if c not in rows.columns and c not in optional]
    if missing:
        raise ValueError(f"{table} lacks {missing}")
    chosen = rows.select(*["reference_id"] * of_reference, *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in names])
    sort = [F.col(c.split()[0]).desc() if c.endswith(" desc") else F.col(c) for c in order]
    keys = [F.col("reference_id")] if of_reference else []
    ordered = chosen.repartitionByRange(*keys, *sort).sortWithinPartitions(*keys, *sort)
    writer = ordered.write.mode(mode).option("header", "true")
    (writer.partitionBy("reference_id") if of_reference else writer).csv(f"{folder}/{table}")


def read_table(spark: SparkSession, folder: str, table: str, dims: int = 2) -> DataFrame:
    """A written table with its types; reference_id comes from the folder's name."""
    text, flags, whole = {"clip_id", "participant_id", "school", "category"}, {"is_reference"}, {"window_index", "window_start_frame", "n_frames", "rank", "start_frame", "end_frame", "window_length_frames", "frame"}
    kind = lambda c: "string" if c in text else "boolean" if c in flags else "long" if c in whole else "double"
    schema = ", ".join(f"`{c}` {kind(c)}" for c in columns_of(table, dims))
    if ORDER[table][1]:
        schema += ", reference_id string"
    return spark.read.schema(schema).option("header", "true").csv(f"{folder}/{table}")


def write_observed(rows: DataFrame, path: str, counts: dict[str, Column], settings: dict | None = None, mode: str = "errorifexists") -> dict:
    """Writes ``rows`` as Parquet at ``path`` and what the write has counted on its way (aggregates of the rows, taken in the same pass) as
    JSON in ``path``_meta, with ``settings``; returns both together."""
    seen = Observation()
    rows.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.mode(mode).parquet(path)
    found = {**(settings or {}), **seen.get}
    spark = rows.sparkSession
    spark.createDataFrame([(json.dumps(found, sort_keys=True),)], "value string").coalesce(1).write.mode(mode).text(f"{path}_meta")
    return found


def quality(value: str = "value", flagged: str = "flagged", filled: str = "filled") -> dict[str, Column]:
    """Counts for ``write_observed``: rows, samples that are missing or flagged, and those that were filled."""
    gone = F.col(value).isNull() | F.col(flagged)
    return {"rows": F.count(F.lit(1)), "missing": F.count_if(F.col(value).isNull()), "flagged": F.count_if(F.col(flagged)), "filled": F.count_if(gone & F.col(filled).isNotNull())}
