"""Sliding windows, their features, and normalisation per clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALID_FRACTION = 0.5
OVERLAP = 0.5


def reference_lengths(frames: DataFrame) -> DataFrame:
    """One row per reference clip: its length in frames and seconds, and the differences from the means."""
    clips = frames.filter("is_reference").groupBy("clip_id", "category").agg(F.count("*").alias("n_frames"), F.max("fps").alias("_fps"))
    duration = F.col("n_frames") / F.col("_fps")
    means = clips.agg(F.avg("n_frames").alias("_mean_n"), F.avg(duration).alias("_mean_s"))
    return clips.join(F.broadcast(means), how="inner").select(  # one row
        "clip_id", "category", "n_frames", F.round("_fps", 2).alias("fps"), duration.alias("duration_s"),
        (F.col("n_frames") - F.col("_mean_n")).alias("diff_from_mean_frames"), (duration - F.col("_mean_s")).alias("diff_from_mean_s"),
    ).orderBy("category", "clip_id")


def window_sizes(frames: DataFrame) -> DataFrame:
    """fps and window_frames: the mean duration of the reference clips in frames of each rate, at least 2."""
    clips = frames.groupBy("clip_key").agg(F.count("*").alias("n"), F.max("fps").alias("fps"), F.max("is_reference").alias("ref"))
    mean = clips.filter("ref").agg(F.avg(F.col("n") / F.col("fps")).alias("mean_s"))
    rates = clips.select("fps").distinct()
    return rates.join(F.broadcast(mean), how="inner").select("fps", F.greatest(F.lit(2), F.bround(F.col("mean_s") * F.col("fps")).cast("int")).alias("window_frames"))


def windowed(signals: DataFrame, window_frames: Column, overlap: float = OVERLAP) -> DataFrame:
    """Each frame once for every window it lies in: window_index, window_start_frame, row (in the window), n_frames.

    Windows start every step frames; a tail that fills no window is left out; a clip shorter than a
    window is one window.
    """
    clip = Window.partitionBy("clip_key")
    placed = signals.withColumn("_t", F.count("*").over(clip)).withColumn("_w", F.least(F.col("_t"), window_frames))
    placed = placed.withColumn("_step", F.greatest(F.lit(1), F.bround(window_frames * overlap).cast("int")))
    i = F.col("frame_index")
    low = F.greatest(F.lit(0), F.ceil((i - F.col("_w") + 1) / F.col("_step")).cast("int"))
    high = F.least(F.floor(i / F.col("_step")), F.floor((F.col("_t") - F.col("_w")) / F.col("_step"))).cast("int")
    spread = placed.withColumn("window_index", F.explode(F.when(low <= high, F.sequence(low, high))))
    return spread.select(
        *signals.columns, "window_index", (F.col("window_index") * F.col("_step")).alias("window_start_frame"),
        (i - F.col("window_index") * F.col("_step")).alias("row"), F.col("_w").alias("n_frames"),
    )


def lead(name: str) -> int:
    """Rows at the start of a window for which a signal has no value: differences look back."""
    return 1 if "_speed_" in name else 2 if "_accel_" in name else 0


def gated(value: Column, length: Column) -> tuple[Column, Column]:
    """Mean and population deviation, NULL where fewer than half of ``length`` values (or 2) are present."""
    enough = F.count(value) >= F.greatest(F.lit(2.0), VALID_FRACTION * F.max(length))
    return F.when(enough, F.avg(value)), F.when(enough, F.stddev_pop(value))


def window_features(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """One row per window: the keys, n_frames and the mean and deviation of each signal."""
    aggs = []
    for n in names:
        skip = lead(n)
        value = F.when(F.col("row") >= skip, F.col(n))
        mean, std = gated(value, F.col("n_frames") - skip)
        aggs += [mean.alias(f"{n}_mean"), std.alias(f"{n}_std")]
    return rows.groupBy(*keys, "window_index", "window_start_frame").agg(F.max("n_frames").alias("n_frames"), *aggs)


def feature_table(signals: DataFrame, names: list[str], keys: list[str], sizes: DataFrame) -> DataFrame:
    """Whole-clip rows of the references and window rows of the others; ``sizes`` has window_frames by fps."""
    sized = signals.join(F.broadcast(sizes), "fps")
    rows = windowed(sized, F.when(F.col("is_reference"), F.lit(2**30)).otherwise(F.col("window_frames")))
    return window_features(rows, names, keys)


def drop_incomplete(table: DataFrame, features: list[str]) -> DataFrame:
    return table.na.drop(how="any", subset=features)


def normalise_at_scale(table: DataFrame, features: list[str]) -> DataFrame:
    """z-scores: references against all references; other clips against themselves, with the pooled
    deviation where their own is 0, and pooled mean and deviation where they have one window. What is
    still missing is 0. A clip's own statistics are taken where its rows lie; the pooled ones, of a group that
    holds nearly all rows, are aggregated first and come back as two rows."""
    clip = Window.partitionBy("is_reference", "clip_id")
    pooled = table.groupBy("is_reference").agg(*[a for f in features for a in (F.avg(f).alias(f"_pm_{f}"), F.stddev_pop(f).alias(f"_ps_{f}"))])
    own = table.select("*", F.count("*").over(clip).alias("_n"), *[a for f in features for a in (F.avg(f).over(clip).alias(f"_cm_{f}"), F.stddev_pop(f).over(clip).alias(f"_cs_{f}"))])
    joined = own.join(F.broadcast(pooled), "is_reference")  # two rows
    alone = ~F.col("is_reference") & (F.col("_n") > 1)
    cols = []
    for f in features:
        mean = F.when(alone, F.col(f"_cm_{f}")).otherwise(F.col(f"_pm_{f}"))
        std = F.when(alone, F.coalesce(F.nullif(F.col(f"_cs_{f}"), F.lit(0.0)), F.col(f"_ps_{f}"))).otherwise(F.col(f"_ps_{f}"))
        cols.append(F.coalesce(F.try_divide(F.col(f) - mean, F.nullif(std, F.lit(0.0))), F.lit(0.0)).alias(f))
    return joined.select(*[c for c in table.columns if c not in features], *cols)


def standard_scale(table: DataFrame, features: list[str]) -> DataFrame:
    """(x - mean) / population deviation over the whole table; a deviation of 0 counts as 1."""
    stats = table.agg(*[a for f in features for a in (F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))])
    joined = table.join(F.broadcast(stats), how="inner")  # one row
    return joined.select(
        *[c for c in table.columns if c not in features],
        *[((F.col(f) - F.col(f"_m_{f}")) / F.coalesce(F.nullif(F.col(f"_s_{f}"), F.lit(0.0)), F.lit(1.0))).alias(f) for f in features],
    )


def pca(table: DataFrame, features: list[str], k: int = 2) -> DataFrame:
    """Scores of the first ``k`` principal components of a centred table, with the explained shares.
    The loading of largest size is positive."""
    import numpy as np
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=features, outputCol="_v").transform(table)
    model = PCA(k=k, inputCol="_v", outputCol="_s").fit(vectors)
    load = model.pc.toArray()
    sign = [float(np.sign(load[np.abs(load[:, i]).argmax(), i]) or 1.0) for i in range(k)]
    scored = model.transform(vectors).withColumn("_a", vector_to_array("_s"))
    share = model.explainedVariance.toArray()
    return scored.select(
        *[c for c in table.columns if c not in features], *[(F.col("_a")[i] * sign[i]).alias(f"pc{i + 1}") for i in range(k)],
        *[F.lit(float(share[i])).alias(f"explained{i + 1}") for i in range(k)],
    )
