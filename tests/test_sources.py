"""Depth blocks and archives, analysis tables, the clip cache, tables read in parts: round trips and crashes."""

import json
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.functions.skeleton import feature_names, signal_names
from strideframe.operators import runs
from strideframe.sources import cache, depth, files, sinks


def recordings(seed=3):
    rng = np.random.default_rng(seed)
    out = {}
    for run, n, h, w, sky in (("a", 150, 3, 5, True), ("b", 7, 2, 2, False)):
        out[run] = (np.arange(10, 10 + n), rng.uniform(0, 60, (n, h, w)).astype(np.float16), rng.random((n, h, w)) > 0.5 if sky else None)
    return out


def frames(spark, data):
    rows = [
        (run, int(i), run == "a", *d.shape[1:], d[k].astype(float).reshape(-1).tolist(), None if s is None else s[k].reshape(-1).tolist())
        for run, (numbers, d, s) in data.items() for k, i in enumerate(numbers)
    ]
    return spark.createDataFrame(rows, depth.FRAMES).repartition(5)


def same(got, data, key="run"):
    assert len(got) == sum(len(n) for n, _, _ in data.values())
    for r in got:
        numbers, d, s = data[r[key]]
        k = int(np.flatnonzero(numbers == r["frame_number"])[0])
        assert (r["h"], r["w"], r["is_metric"]) == (*d.shape[1:], r[key] == "a")
        assert np.array_equal(np.array(r["depth"], np.float32), d[k].astype(np.float32).reshape(-1))
        assert (r["sky"] is None) == (s is None) and (s is None or r["sky"] == s[k].reshape(-1).tolist())


def test_depth_blocks(spark, tmp_path):
    data = recordings()
    depth.write_blocks(frames(spark, data), f"{tmp_path}/d", block=32)
    same(depth.read_blocks(spark, f"{tmp_path}/d").collect(), data)
    part = depth.read_blocks(spark, f"{tmp_path}/d", run="a", first=70, last=71)
    same(part.collect(), {"a": tuple(x[60:62] for x in data["a"])})
    plan = part._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PushedFilters") - 700 :]  # the conditions reach the scan
    assert re.search(r"last_frame#\d+ >= 70", scan) and re.search(r"first_frame#\d+ <= 71", scan)
    held = spark.read.parquet(f"{tmp_path}/d")
    assert held.filter("run = 'a'").count() == 5  # frames 10 to 159 in blocks of 32
    assert depth.read_blocks(spark, f"{tmp_path}/d", run="nobody").count() == 0


def test_depth_values_wrap(spark):
    bits = np.array([-32768, 32767, -1, 0, 32767, -32768], np.int16).reshape(6, 1, 1)
    assert (depth.unpack_depth(depth.pack_depth(bits.view(np.float16)), 6, 1, 1).view(np.int16) == bits).all()


def test_archives_are_read_as_written(spark, tmp_path):
    data = recordings(4)
    for r in depth.archives(frames(spark, data), level=1).collect():
        (tmp_path / f"{r['run']}.npz").write_bytes(bytes(r["content"]))
    numbers, d, s = data["a"]
    np.savez_compressed(tmp_path / "old.npz", depth=d, frame_indices=numbers, is_metric=True, sky=s)  # as older files are
    got = [r.asDict() | {"path": Path(r["path"]).stem} for r in files.read_depth(spark, f"{tmp_path}/*.npz").collect()]
    same([r for r in got if r["path"] != "old"], data, "path")
    same([r | {"path": "a"} for r in got if r["path"] == "old"], {"a": data["a"]}, "path")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = frames(spark, recordings()).withColumn("h", F.when(F.col("frame_number") == 100, F.lit(77)).otherwise(F.col("h")))
    with pytest.raises(Exception):
        depth.write_blocks(bad, f"{tmp_path}/d", block=32)
    assert not list(Path(tmp_path).rglob("*.parquet")) and not (tmp_path / "d" / "_SUCCESS").exists()


def value_of(name, i):
    return name if name in ("clip_id", "participant_id", "school", "category") else i % 2 == 0 if name == "is_reference" else i


@pytest.mark.parametrize("table", sorted(sinks.COLUMNS))
def test_analysis_tables(spark, tmp_path, table):
    names = sinks.columns_of(table)
    rows = [{c: value_of(c, i) for c in names} | {"reference_id": f"ref {i % 2}", "extra": 1} for i in range(6)]
    df = spark.createDataFrame(rows)
    missing = names[-1]
    df = df.withColumn(missing, F.when(F.col(missing) != 4, F.col(missing)))
    sinks.write_table(df, str(tmp_path), table)
    text = next(f for f in sorted((tmp_path / table).rglob("part-*.csv"))).read_text().splitlines()
    assert text[0] == ",".join(names)
    got = sinks.read_table(spark, str(tmp_path), table).collect()
    want = [{c: (None if c == missing and r[c] == 4 else r[c]) for c in [*names, *["reference_id"] * sinks.ORDER[table][1]]} for r in rows]
    order = lambda r: tuple(str(r[c]) for c in sorted(r))
    assert sorted((r.asDict() for r in got), key=order) == sorted(want, key=order)
    assert sorted(p.name for p in (tmp_path / table).iterdir() if p.is_dir()) == (["reference_id=ref 0", "reference_id=ref 1"] if sinks.ORDER[table][1] else [])
    with pytest.raises(ValueError, match="lacks"):
        sinks.write_table(df.drop(missing), f"{tmp_path}/x", table)


def test_tables_have_the_features_of_their_layout():
    assert sinks.columns_of("neighbors")[8:-2] == feature_names(2) and sinks.columns_of("kinematic_timeseries", 3)[2:] == signal_names(3)


HEAD = "scorer,s,s,s\nindividuals,i,i,i\nbodyparts,nose,nose,nose\ncoords,x,y,likelihood\n"


def source(folder, name, values, time):
    import os

    path = folder / f"{name}.csv"
    path.write_text(HEAD + "".join(f"frame_{i:04d},{v},0,1\n" for i, v in enumerate(values)))
    os.utime(path, (time, time))


def state(spark, at):
    found = cache.cached(spark, at)
    return sorted((Path(r["path"]).stem, r["frame_number"], r["kp"][0]["x"]) for r in found.select("path", "frame_number", "kp").collect())


def test_the_cache_follows_its_sources(spark, tmp_path):
    raw, at = tmp_path / "raw", f"{tmp_path}/cache"
    raw.mkdir()
    source(raw, "a", [1, 2], 1000)
    source(raw, "b", [3], 1000)
    source(raw, "empty", [], 1000)
    seen = []

    def parse(paths):
        seen.append(sorted(Path(p).stem for p in paths))
        return files.read_pose_csv(spark, paths).drop("frame_index")

    run = lambda **more: cache.refresh(spark, files.listing(spark, str(raw)), at, parse, **more)
    assert cache.cached(spark, at) is None and run() == 3 and run() == 0
    assert state(spark, at) == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0)]
    source(raw, "a", [9], 2000)
    source(raw, "c", [4], 2000)
    assert run() == 2 and seen[-1] == ["a", "c"]
    first = [("a", 0, 9.0), ("b", 0, 3.0), ("c", 0, 4.0)]
    assert state(spark, at) == first

    def crash(paths):
        rows = parse(paths)
        return rows.withColumn("kp", F.when(F.assert_true(F.col("frame_number") < 1).isNull(), F.col("kp")))

    source(raw, "c", [5, 6], 3000)
    with pytest.raises(Exception):
        cache.refresh(spark, files.listing(spark, str(raw)), at, crash)
    assert state(spark, at) == first and len(cache.committed(spark, at)) == 2  # what was cut off does not count
    assert run() == 1 and run() == 0
    assert state(spark, at) == [("a", 0, 9.0), ("b", 0, 3.0), ("c", 0, 5.0), ("c", 1, 6.0)]
    assert run(force=True, files_a_batch=3) == 4 and len(state(spark, at)) == 4 and len(cache.committed(spark, at)) == 5


def test_one_large_table_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text(HEAD + "".join(f"frame_{i:05d},{i},{i / 2},1\n" for i in range(20_000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        df = files.read_pose_csv(spark, f"{tmp_path}/big.csv")
        assert spark.read.text(f"{tmp_path}/big.csv").rdd.getNumPartitions() > 4
        wrong = df.filter((F.col("frame_index") != F.col("frame_number")) | (F.col("kp")[0]["x"] != F.col("frame_number")) | (F.col("kp")[0]["y"] != F.col("frame_number") / 2))
        assert df.count() == 20_000 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_box_tables(spark, tmp_path):
    rows = [(1, 3, [[1.5, 2.0, 3.0, 4.0], [0.0, 0.0, 1.0, 1.0]], ["left", "right"]), (1, 12, [], [])]
    files.write_boxes(spark.createDataFrame(rows, "clip_key long, frame_number int, boxes array<array<double>>, hand_labels array<string>"), f"{tmp_path}/b")
    got = files.read_boxes(spark, f"{tmp_path}/b/clip_key=1").orderBy("frame_number").collect()
    assert [(r["frame_number"], r["boxes"], r["hand_labels"]) for r in got] == [r[1:] for r in rows]
    (tmp_path / "x.csv").write_text("frame_label,bboxes,hand_labels\nframe_0007,\"[[1, 2, 3, nan]]\",\"['left']\"\n")
    assert files.read_boxes(spark, f"{tmp_path}/x.csv").first()["boxes"] == [[1.0, 2.0, 3.0, None]]


def test_selections(spark):
    middle = spark.createDataFrame([(1, i, 100 + i, i == 5) for i in range(10)], "clip_key long, frame_index int, frame_number int, is_middle boolean")
    videos = spark.createDataFrame([(1, "v.mp4", "a.csv", "b.csv")], "clip_key long, video string, pose_2d_csv string, pose_3d_csv string")
    r = files.selections(middle, videos).first()
    assert json.loads(r["selection"]) == {"video": "v.mp4", "pose_2d_csv": "a.csv", "pose_3d_csv": "b.csv", "prediction_rows": [*range(10)], "video_frames": [*range(100, 110)], "middle_video_frame": 105}
    assert json.loads(r["angle_sweep"]) == {"frame": 105, "elevation_degrees": 0, "azimuth_degrees": [*range(0, 360, 36)]}


def test_videos_by_each_rule(spark):
    names = ["run1/visualization_x.mp4", "run1/a_run1.mp4", "run1/results_y.avi", "run1/z.MP4", "run2/bboxes_run2.mp4", "run2/notes.txt"]
    listing = spark.createDataFrame([(f"file:/d/{n}",) for n in names], "path string")
    of = lambda rule: {r["folder"][-4:]: r["video"].split("/")[-1] for r in files.first_videos(listing, rule).collect()}
    assert of("made") == {"run1": "a_run1.mp4"} and of("drawn") == {"run1": "a_run1.mp4", "run2": "bboxes_run2.mp4"} and of("run") == {"run1": "results_y.avi"}
    rates = spark.createDataFrame([(float("nan"),), (None,), (0.0,), (25.0,)], "f double").select(files.fps_or_default(F.col("f")).alias("f")).collect()
    assert [r["f"] for r in rates] == [30.0, 30.0, 30.0, 25.0]


def test_streamed_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source(tmp_path, "like", [1], 1000)
    source(tmp_path / "in", "a", [1, 2], 1000)
    stream = files.stream_pose_csv(spark, f"{tmp_path}/in", f"{tmp_path}/like.csv")
    def run():
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted((Path(r["path"]).stem, r["frame_number"], r["kp"][0]["x"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert run() == [("a", 0, 1.0), ("a", 1, 2.0)]
    source(tmp_path / "in", "b", [7], 1000)
    assert run() == run() == [("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 7.0)]


def test_writes_count_what_they_see(spark, tmp_path):
    rows = [(1.0, False, 1.0), (None, False, None), (3.0, True, 2.0), (4.0, True, None)]
    df = spark.createDataFrame(rows, "value double, flagged boolean, filled double")
    got = sinks.write_observed(df, f"{tmp_path}/t", sinks.quality(), {"window": 10})
    assert got == {"window": 10, "rows": 4, "missing": 1, "flagged": 2, "filled": 1}
    assert json.loads(spark.read.text(f"{tmp_path}/t_meta").first()[0]) == got and spark.read.parquet(f"{tmp_path}/t").count() == 4


def test_fit_settings(spark):
    report = spark.createDataFrame([(1, "a-b", 0.5), (1, "b-c", None)], "clip_key long, bone string, median_m_before double")
    got = json.loads(runs.fit_settings(report, iterations=7).first()["settings"])
    assert got == {"iterations": 7, "stiffness": 1.0, "min_likelihood": 0.5, "min_likelihood_hand": 0.05, "post_fit_smoothing_window": 10, "reference_lengths_m": {"a-b": 0.5, "b-c": None}}
