"""Window statistics and speeds of a stream of samples: clip_key, ts, value."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SPEED = "clip_key long, ts timestamp, speed double"


def window_stats(stream: DataFrame, size: str = "10 minutes", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """clip_key, window_start, n, mean and std of each half-overlapping time window. Samples that come later than
    ``late`` are left out, and with them the state of a window goes."""
    windows = stream.withWatermark("ts", late).groupBy("clip_key", F.window("ts", size, slide).alias("w"))
    return windows.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).select("clip_key", F.col("w.start").alias("window_start"), "n", "mean", "std")


def _speed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Change a second since the sample before; the last sample of a clip is its state."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
    before = state.getOption or (None, None)
    seconds, values = rows["ts"].map(lambda t: t.timestamp()), rows["value"]
    gap = seconds - seconds.shift(fill_value=before[0]) if before[0] is not None else seconds.diff()
    step = values - values.shift(fill_value=before[1]) if before[0] is not None else values.diff()
    latest = (float(seconds.iloc[-1]), float(values.iloc[-1]))
    latest = latest if before[0] is None or latest[0] >= before[0] else before  # an older sample does not set the state back
    state.update(latest)
    state.setTimeoutTimestamp(max(int(latest[0] * 1000), state.getCurrentWatermarkMs()) + 3_600_000)
    yield pd.DataFrame({"clip_key": key[0], "ts": rows["ts"], "speed": (step / gap).where(gap > 0)})


def speeds(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """clip_key, ts and speed of each sample, across micro-batches. A clip's state goes once the watermark is an hour past
    its last sample."""
    marked = stream.withWatermark("ts", late)
    return marked.groupBy("clip_key").applyInPandasWithState(_speed, SPEED, "at double, value double", "append", GroupStateTimeout.EventTimeTimeout)


def read_samples(spark: SparkSession, folder: str, file: str = "events.parquet") -> DataFrame:
    """The samples of a folder's event files as a stream."""
    raw = spark.readStream.schema("user_id long, ts timestamp_ntz, value double").option("pathGlobFilter", file).parquet(folder)
    return raw.select(F.col("user_id").alias("clip_key"), F.col("ts").cast("timestamp").alias("ts"), "value")


def run_once(out: DataFrame, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Everything that is there now, as a table in memory. ``checkpoint``: a folder that all executors share; on a cluster
    it must be given."""
    spark = out.sparkSession
    if checkpoint is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a shared checkpoint folder is needed")
    name = f"stream_{uuid.uuid4().hex}"
    writer = out.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start().awaitTermination()
    return spark.table(name)
