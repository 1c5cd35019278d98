"""Streams against the same work on whole tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from strideframe.streaming import signals


def write(spark, folder, rows):
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").coalesce(1).write.mode("append").parquet(folder)


def at(second):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)


def test_windows_of_a_stream(spark, sf):
    got = signals.run_once(signals.window_stats(signals.read_samples(spark, sf), "1 hour", "30 minutes"))
    table = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("clip_key"), F.col("ts").cast("timestamp").alias("ts"), "value")
    want = signals.window_stats(table, "1 hour", "30 minutes")
    key = lambda r: (r["clip_key"], r["window_start"])
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert (key(x), x["n"]) == (key(y), y["n"]) and x["mean"] == pytest.approx(y["mean"]) and x["std"] == pytest.approx(y["std"])


def test_speeds_go_on_across_batches(spark, tmp_path):
    folder, checkpoint = f"{tmp_path}/in", f"{tmp_path}/state"
    write(spark, folder, [(1, at(0), 1.0), (1, at(2), 5.0), (2, at(0), 7.0)])
    stream = lambda: signals.speeds(signals.read_samples(spark, folder, "*.parquet"))
    first = [tuple(r) for r in signals.run_once(stream(), "append", checkpoint).orderBy("clip_key", "ts").select("clip_key", "speed").collect()]
    assert first == [(1, None), (1, 2.0), (2, None)]
    write(spark, folder, [(1, at(6), 1.0)])
    again = stream().writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/s2").trigger(availableNow=True).option("maxFilesPerTrigger", 1)
    again.start().awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("clip_key", "ts").collect()
    assert [(r["clip_key"], r["speed"]) for r in rows] == [(1, None), (1, 2.0), (1, -1.0), (2, None)]


def test_an_older_sample_does_not_set_the_state_back(spark, tmp_path):
    folder = f"{tmp_path}/in"
    for rows in ([(1, at(10), 1.0)], [(1, at(4), 50.0)], [(1, at(12), 5.0)]):  # a batch each
        write(spark, folder, rows)
        out = signals.speeds(signals.read_samples(spark, folder, "*.parquet")).writeStream.outputMode("append").format("parquet")
        out.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("ts").collect()
    assert [r["speed"] for r in got] == [None, None, 2.0]
