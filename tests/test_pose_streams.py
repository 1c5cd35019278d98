"""Streams of poses against their batch forms, with late rows and several batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strideframe.operators import scans
from strideframe.sources import files
from strideframe.streaming import poses, recordings

T0 = dt.datetime(2024, 1, 1)
SAMPLE = "clip_key long, frame_index long, ts timestamp, value double, fps double, flagged boolean"


@pytest.fixture
def store(spark):
    key, cls = poses.STATE_STORE
    kept = spark.conf.get(key, None)
    spark.conf.set(key, cls)
    yield
    spark.conf.unset(key) if kept is None else spark.conf.set(key, kept)


def fed(spark, folder, name, batches, schema, build, files=1):
    """Rows of ``build`` over a stream that gets the batches one by one, and the queries' last progress."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}/{k:03d}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}")


def drained(out, folder, spark):
    q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out"), q.recentProgress


def samples(seed):
    rng = random.Random(seed)
    rows = []
    for clip in (1, 2, 3):
        for i in range(40):
            rows.append((clip, i, T0 + dt.timedelta(seconds=10 * i + clip), None if rng.random() < 0.1 else float(rng.randrange(100)), 30.0, rng.random() < 0.3))
    return rows


def test_motion_is_that_of_the_batch(spark, tmp_path, store):
    rows = samples(4)
    shuffled = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=random.Random(r[0] * 100 + r[1]).randrange(60)))  # late by up to a minute
    batches = [shuffled[k : k + 17] for k in range(0, len(shuffled), 17)]
    batches.append([(9, 0, T0 + dt.timedelta(days=1), 1.0, 30.0, False)])  # time goes on, and the clips end
    batches.append([(9, 1, T0 + dt.timedelta(days=2), 1.0, 30.0, False)])
    stream = fed(spark, tmp_path, "in", batches, SAMPLE, None)
    got, progress = drained(poses.motion(stream, "2 minutes"), tmp_path, spark)
    batch = scans.fill_gaps(spark.createDataFrame(rows, SAMPLE), "value", "flagged")
    want = scans.differences(batch, ["filled"], F.col("fps"))
    mine = {(r["clip_key"], r["frame_index"]): (r["filled"], r["speed"], r["acceleration"]) for r in got.filter("clip_key < 9").collect()}
    theirs = {(r["clip_key"], r["frame_index"]): (r["filled"], r["d1_filled"], r["d2_filled"]) for r in want.collect()}
    assert mine.keys() == theirs.keys()
    for key, values in theirs.items():
        assert mine[key] == pytest.approx(values), key
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) > 0


def test_depth_joins_as_in_the_batch(spark, tmp_path):
    ps, ds = "run string, frame_number int, ts timestamp, kp array<double>", "run string, frame_number int, ts timestamp, depth array<float>"
    at = lambda i: T0 + dt.timedelta(seconds=i)
    pose = [("a", i, at(10 * i), [float(i)]) for i in range(60)]
    deep = [("a", i, at(10 * i + 3), [float(i), 0.0]) for i in range(60) if i % 4]
    end = lambda k: [("z", k, T0 + dt.timedelta(days=k), None)]
    left = fed(spark, tmp_path, "pose", [pose[:20], pose[20:45], pose[45:], end(1), end(2), end(3)], ps, None)
    right = fed(spark, tmp_path, "depth", [deep[30:], deep[:30], [], end(1), end(2), end(3)], ds, None)
    got, progress = drained(poses.with_depth(left, right, "20 minutes"), tmp_path, spark)
    mine = {r["frame_number"]: r["depth"] and r["depth"][0] for r in got.filter("run = 'a'").collect()}
    assert mine == {i: float(i) if i % 4 else None for i in range(60)}
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress if p["stateOperators"]]
    assert max(held) > 60 and held[-1] < 20  # both sides' state goes


def test_new_recordings_are_worked_off_once(spark, tmp_path):
    """Two runs and a crash between them give what one run gives."""
    head = "scorer,s,s,s\nindividuals,i,i,i\nbodyparts,nose,nose,nose\ncoords,x,y,likelihood\n"
    put = lambda name, x: (tmp_path / "in" / f"{name}.csv").write_text(f"{head}frame_0001,{x},0,1\n")
    (tmp_path / "in").mkdir()
    seen = []

    def work(paths):
        seen.append([p.split("/")[-1] for p in paths])
        return files.read_pose_csv(spark, paths).select("path", "frame_number", F.col("kp")[0]["x"].alias("x"))

    def run(how=work, **more):
        return recordings.follow(spark, f"{tmp_path}/in", f"{tmp_path}/out", how, f"{tmp_path}/cp", **more)

    def state():
        return sorted((r["path"].split("/")[-1], r["x"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put("a", 1), put("b", 2)
    assert run(files_a_batch=1) == 2 and run() == 0 and state() == [("a.csv", 1.0), ("b.csv", 2.0)]
    put("c", 3), put("d", 4)
    with pytest.raises(Exception):
        run(lambda paths: work(paths).withColumn("x", F.when(F.assert_true(F.col("x") < 4).isNull(), F.col("x"))))
    assert run() == 1 and run() == 0
    assert state() == [("a.csv", 1.0), ("b.csv", 2.0), ("c.csv", 3.0), ("d.csv", 4.0)] and seen[-1] == seen[-2] == ["c.csv", "d.csv"]
