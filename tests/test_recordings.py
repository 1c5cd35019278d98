"""Sources on written files, whole runs against plain loops, and small cases with known results."""

import io
import json

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from strideframe.functions.skeleton import BODYPARTS, FULL_2D, FULL_3D
from strideframe.operators import features, lifting, poses, progress, runs, signals
from strideframe.operators.matching import best_matches, channel_weights, match_table
from strideframe.plans import recordings
from strideframe.sources import files

KP2, KP3 = ("array<struct<x:double,y:double,lik:double>>", "array<struct<x:double,y:double,z:double,lik:double>>")
CLIP = "clip_key long, clip_id string, frame_index int, frame_number long, fps double, is_reference boolean, category string"


def frames_of(spark, clips, dims=2, numbers=None, fps=30.0):
    """Frames of {clip: (frames, joints, dims + 1)} arrays; NaN is missing."""
    rows = []
    names = ["x", "y", "lik"] if dims == 2 else ["x", "y", "z", "lik"]
    for key, values in clips.items():
        for i, joints in enumerate(values):
            kp = [{n: None if np.isnan(v) else float(v) for n, v in zip(names, j)} for j in joints]
            rows.append((key, f"clip{key}", i, (numbers or range(10**6))[i], fps, False, "c", kp))
    return spark.createDataFrame(rows, f"{CLIP}, kp {KP2 if dims == 2 else KP3}")


def body(n, layout=FULL_2D):
    """Still poses with shoulders one apart; all joints confident."""
    out = np.zeros((n, len(BODYPARTS), layout.dims + 1))
    out[..., -1] = 1.0
    out[:, layout.slot("right_shoulder"), 0] = 1.0
    return out


def signals_of(spark, clip, numbers=None, layout=FULL_2D):
    df = signals.frame_signals(frames_of(spark, {1: clip}, layout.dims, numbers), layout)
    return df.orderBy("frame_index").collect()


def test_linear_wrist_and_frame_gaps(spark):
    clip = body(60)
    for side in ("left", "right"):
        clip[:, FULL_2D.slot(f"{side}_wrist_hand"), 0] = 0.01 * np.arange(60)
    for numbers in (None, [0, 1, 5, 6, *range(7, 63)]):  # neighbours are adjacent rows, whatever their numbers
        got = signals_of(spark, clip, numbers)
        assert got[0]["hand_speed_x"] is None and got[0]["hand_accel_x"] is None and got[1]["hand_accel_x"] is None
        assert all(r["hand_speed_x"] == pytest.approx(0.3) for r in got[1:]) and all(r["hand_accel_x"] == pytest.approx(0, abs=1e-9) for r in got[2:])


@pytest.mark.parametrize("wrist, degrees", [((1.0, 1.0), 90.0), ((0.0, 2.0), 180.0)])
def test_elbow_angles(spark, wrist, degrees):
    clip = np.zeros((2, 59, 4))
    clip[..., 3] = 1.0
    clip[:, FULL_3D.slot("left_shoulder"), 0] = 1.0  # facing the camera
    for side, x in (("left", 1.0), ("right", 0.0)):
        clip[:, FULL_3D.slot(f"{side}_elbow"), :2] = (x, 1.0)
        clip[:, FULL_3D.slot(f"{side}_wrist"), :2] = (x + wrist[0], wrist[1])
    assert signals_of(spark, clip, layout=FULL_3D)[0]["elbow_angle"] == pytest.approx(degrees)


@pytest.mark.parametrize("n_low, kept", [(12, False), (10, True)])  # of 20 frames
def test_half_of_the_values_must_be_there(spark, n_low, kept):
    clip = body(20)
    clip[:n_low, FULL_2D.slot("left_wrist_hand"), 2] = 0.05
    s = signals.frame_signals(frames_of(spark, {1: clip}), FULL_2D).withColumn("is_reference", F.lit(True))
    sizes = spark.createDataFrame([(30.0, 5)], "fps double, window_frames int")
    row = features.feature_table(s, ["wrist_distance"], ["clip_key"], sizes).first()
    assert (row["wrist_distance_mean"] is not None) == kept


def test_short_clips_and_single_or_flat_windows(spark):
    rows = [(k, f"c{k}", i, 30.0, False, float(v)) for k, x in {1: [1, 2, 3], 2: [4] * 12, 3: range(12)}.items() for i, v in enumerate(x)]
    s = spark.createDataFrame(rows, "clip_key long, clip_id string, frame_index int, fps double, is_reference boolean, value double")
    sizes = spark.createDataFrame([(30.0, 6)], "fps double, window_frames int")
    table = features.feature_table(s, ["value"], ["clip_key", "clip_id", "is_reference"], sizes)
    got = {(r["clip_key"], r["window_index"]): (r["window_start_frame"], r["n_frames"]) for r in table.collect()}
    assert got == {(1, 0): (0, 3), **{(k, i): (3 * i, 6) for k in (2, 3) for i in range(3)}}
    z = {(r["clip_id"], r["window_index"]): r["value_mean"] for r in features.normalise_at_scale(table, ["value_mean", "value_std"]).collect()}
    means = np.array([2.0, 4, 4, 4, 2.5, 5.5, 8.5])
    assert z["c1", 0] == pytest.approx((2.0 - means.mean()) / means.std())  # one window: pooled
    assert [z["c2", i] for i in range(3)] == [0, 0, 0]  # flat: own mean, pooled deviation
    assert z["c3", 0] == pytest.approx(-(1.5**0.5))


def test_three_sources_and_the_wrist(spark):
    def kp(n, value, missing=()):
        return [{"x": float(value), "y": float(j), "lik": None if j in missing else 0.5} for j in range(n)]

    schema = f"frame_number long, kp {KP2}"
    b = spark.createDataFrame([(i, kp(17, 1, (9,) if i == 2 else ())) for i in range(4)], schema)
    f = spark.createDataFrame([(i, kp(59, 2)) for i in range(2, 6)], schema)
    h = spark.createDataFrame([(i, kp(42, 3)) for i in range(1, 5)], schema)
    got = {r["frame_number"]: [k and k["x"] for k in r["kp"]] for r in poses.merge_pose_sources(b, f, h).collect()}
    assert sorted(got) == list(range(6))
    assert got[0][:17] == [1.0] * 17 and got[0][18] is None and got[0][17] == 1.0  # the hand root follows the body's wrist
    assert got[5][0] == 2.0 and got[1][18] == 3.0 and got[5][18] == 2.0
    assert got[2][9] == 2.0 and got[2][17] == 2.0 and got[4][17] == 2.0  # never the hand model's own root


def test_a_spike_is_smoothed_and_a_missing_centre_stays(spark):
    clip = np.zeros((7, 1, 3))
    clip[..., 2] = 1.0
    clip[3, 0, :2] = 9.0
    clip[5, 0, 2] = np.nan
    got = [(r["x"], r["lik"]) for r in runs.smooth_poses(frames_of(spark, {1: clip})).orderBy("frame_number").collect()]
    assert got == [(0.0, 1.0)] * 5 + [(0.0, None), (0.0, 1.0)]
    with pytest.raises(ValueError):
        runs.smooth_poses(frames_of(spark, {1: clip}), 4)


def test_gaps_are_filled_between_good_samples(spark):
    rows = [(1, i, float(i) if i not in (3, 4, 0) else 99.0, i in (0, 3, 4)) for i in range(8)]
    df = spark.createDataFrame(rows, "clip_key long, frame_index int, z double, bad boolean")
    got = [r["z"] for r in df.withColumn("z", poses.fill_gaps(df, "z", "bad")).orderBy("frame_index").collect()]
    assert got == [None, 1, 2, 3, 4, 5, 6, 7]


def test_matches_at_other_speeds_ties_and_short_series():
    r = np.random.default_rng(5)
    query = r.normal(size=(20, 1))
    series = r.normal(size=(120, 1))
    series[40:70, 0] = np.repeat(query[:, 0], [2, 1] * 10)  # stretched 1.5 times
    assert best_matches(query, [series], np.ones(1)) == [(40, 30, 0.0)]
    flat = np.zeros((30, 1))
    assert best_matches(np.zeros((10, 1)), [flat], np.ones(1)) == [(0, 5, 0.0)]  # the shorter, then the earlier
    assert best_matches(query, [r.normal(size=(9, 1))], np.ones(1)) == [None]


def test_flat_channels_weigh_nothing(spark):
    rows = [(f"r{k}", True, float(i * k), 5.0) for k in (1, 2) for i in range(10)]
    df = spark.createDataFrame(rows, "clip_id string, is_reference boolean, a double, b double")
    assert {(r["clip_id"], r["channel"]): r["weight"] for r in channel_weights(df, ["a", "b"]).collect()} == {("r1", "a"): 1, ("r1", "b"): 0, ("r2", "a"): 1, ("r2", "b"): 0}


def test_hand_boxes_end_at_the_last_pixel(spark):
    rows = [(1, "left", x, y, 0.9) for x, y in ((600.0, 100.0), (639.5, 200.0))] + [(2, "left", 5.0, 5.0, 0.9)] * 2 + [(3, "left", float("nan"), 5.0, 0.9), (3, "left", 7.0, 5.0, 0.9)]
    df = spark.createDataFrame(rows, "frame long, side string, x double, y double, lik double")
    got = lifting.hand_boxes(df, ["frame", "side"], 640, 480).collect()
    assert len(got) == 1
    assert (got[0]["x"], got[0]["x"] + got[0]["size_x"], got[0]["y"], got[0]["size_y"]) == (580.5, 639.0, 50.0, 200.0)


def test_a_ramp_is_sampled_exactly(spark):
    depth = [float(x + 10 * y) for y in range(5) for x in range(6)]
    df = spark.createDataFrame([(depth, x, y) for x, y in ((2.5, 1.25), (-3.0, 9.0), (7.0, 0.5), (5.0, 4.0))], "depth array<double>, x double, y double")
    got = [r[0] for r in df.select(lifting.bilinear(F.col("depth"), F.col("x"), F.col("y"), F.lit(6), F.lit(5))).collect()]
    assert got == [15.0, 40.0, 10.0, 45.0]


def plain_fit(p, lik, bones, lengths, floors, iterations, stiffness):
    p = [[list(map(float, j)) for j in f] for f in p]
    for t, f in enumerate(p):
        for _ in range(iterations):
            for (i, j), target in zip(bones, lengths):
                d = [b - a for a, b in zip(f[i], f[j])]
                n = sum(x * x for x in d) ** 0.5
                mi, mj = 1 / max(lik[t][i], floors[i]), 1 / max(lik[t][j], floors[j])
                for k in range(3):
                    step = stiffness * (n - target) / max(n, 1e-6) * d[k]
                    f[i][k] += mi / (mi + mj) * step
                    f[j][k] -= mj / (mi + mj) * step
    return p


def test_fits_are_the_plain_solver():
    r = np.random.default_rng(2)
    p, lik = r.normal(size=(3, 5, 3)), r.random((3, 5))
    bones, lengths, floors = [(0, 1), (1, 2), (2, 3), (1, 4)], np.array([1.0, 0.5, 0.7, 1.2]), np.array([0.5, 0.5, 0.05, 0.05, 0.5])
    assert np.allclose(lifting.relax(p, lik, bones, lengths, floors, 7, 0.8), plain_fit(p, lik, bones, lengths, floors, 7, 0.8))
    exact = np.array([[[0, 0, 0], [1, 0, 0]]], float)
    assert np.allclose(lifting.relax(exact, np.ones((1, 2)), [(0, 1)], np.array([1.0]), np.full(2, 0.5)), exact)
    stretched = lifting.relax(np.array([[[0, 0, 0], [2, 0, 0]]], float), np.array([[1.0, 0.5]]), [(0, 1)], np.array([1.0]), np.full(2, 0.05))
    assert np.allclose(np.linalg.norm(stretched[0, 1] - stretched[0, 0]), 1) and abs(stretched[0, 0, 0]) < abs(stretched[0, 1, 0] - 2)


def test_the_fit_run_is_lengths_fit_and_smoothing(spark):
    skeleton, floors = runs.full_skeleton()
    assert len(skeleton) == 55
    r = np.random.default_rng(7)
    clip = np.concatenate([r.normal(size=(12, 59, 3)), r.uniform(0.5, 1, (12, 59, 1))], axis=2)
    fitted, report = runs.fit_run(frames_of(spark, {1: clip}, 3), skeleton, floors, iterations=5)
    bones = [(i, j) for _, _, i, j in skeleton]
    gaps = np.array([np.linalg.norm(clip[:, i, :3] - clip[:, j, :3], axis=1) for i, j in bones])
    mirror = [m for _, m, _, _ in skeleton]
    lengths = np.array([np.median(np.concatenate([gaps[k] for k in range(55) if mirror[k] == m])) for m in mirror])
    solved = np.array(plain_fit(clip[..., :3], clip[..., 3], bones, lengths, floors, 5, 1.0))
    want = np.array([np.median(solved[max(0, t - 5) : t + 5], axis=0) for t in range(12)])
    got = np.zeros((12, 59, 3))
    for x in fitted.collect():
        got[x["frame_index"], x["joint"]] = (x["x"], x["y"], x["z"])
    assert np.allclose(got, want)
    stats = {x["bone"]: x for x in report.collect()}
    assert len(stats) == 55 and all(x["n_before"] == x["n_after"] for x in stats.values())
    assert np.mean([x["cv_after"] for x in stats.values()]) < np.mean([x["cv_before"] for x in stats.values()])


def test_registered_fits(spark, sf):
    rows = recordings.skeleton_fit_report(spark, sf).collect()
    assert {r["bone"] for r in rows} == {n for n, _, _, _ in runs.full_skeleton()[0]}
    assert np.mean([r["cv_after"] for r in rows if r["cv_after"]]) < np.mean([r["cv_before"] for r in rows if r["cv_before"]])
    assert recordings.skeleton_fit(spark, sf).count() == 500 * 59


def test_metric_depth_is_not_scaled(spark):
    frames = spark.createDataFrame([(1, 0, 7, [{"x": 4.0, "y": 2.0, "lik": 1.0}] * 2)], f"run long, frame_index int, frame_number long, kp {KP2}")
    rasters = spark.createDataFrame([(1, 7, 8, 8, [2.0] * 64)], "run long, frame_number long, w int, h int, depth array<double>")
    got = runs.lift_run(frames, rasters, [], (0, 1), 8, 8, metric=True).collect()
    assert [(r["joint"], r["x"], r["y"], r["z"]) for r in got] == [(0, 0.0, -0.5, 2.0), (1, 0.0, -0.5, 2.0)]
    row = spark.range(1).select(runs.lift_settings(8, 6, 8.0, False, F.lit(0.5), F.lit(3)).alias("j")).first()
    assert json.loads(row["j"]) == {"is_metric": True, "depth_scale": 0.5, "assumed_focal_length_px": 8.0, "shoulder_width_m": 0.4, "n_calibration_samples": 3, "frame_width": 8, "frame_height": 6}


@pytest.mark.parametrize("dims", [2, 3])
def test_pose_tables_are_read_as_written(spark, tmp_path, dims):
    r = np.random.default_rng(4)
    clips = {k: r.normal(size=(n, 59, dims + 1)) for k, n in ((1, 3), (2, 12))}
    clips[1][1, 5, 0] = np.nan
    files.write_pose_csv(frames_of(spark, clips, dims, numbers=[*range(95, 110)]), f"{tmp_path}/out", "merged-body-hand", dims)
    got = files.read_pose_csv(spark, f"{tmp_path}/out/*/*.txt", dims).collect()
    assert len(got) == 15
    for x in got:
        key = int(x["path"].split("clip_key=")[1].split("/")[0])
        assert x["frame_number"] == 95 + x["frame_index"]  # frame_0100 comes after frame_0099
        want = clips[key][x["frame_index"]]
        mine = np.array([[np.nan if v is None else v for v in k] for k in x["kp"]], float)
        assert np.allclose(mine, want, equal_nan=True)


def test_scorers_and_individuals_collapse_to_the_first_value(spark, tmp_path):
    text = (
        "scorer,a,a,a,b,b\nindividuals,i0,i0,i0,i1,i1\nbodyparts,nose,nose,nose,nose,left_eye\ncoords,x,y,likelihood,x,x\n"
        "frame_0003,,2,0.5,7,8\nframe_0001,1,2,0.5,9,\n"
    )
    (tmp_path / "a.csv").write_text(text)
    got = files.read_pose_csv(spark, f"{tmp_path}/a.csv").orderBy("frame_index").collect()
    assert [(x["frame_number"], x["kp"][0]["x"], x["kp"][1]["x"], x["kp"][2]["x"]) for x in got] == [(1, 1.0, None, None), (3, 7.0, 8.0, None)]
    (tmp_path / "b.csv").write_text(text.replace("frame_0003", "third"))
    with pytest.raises(Exception, match="Unexpected frame label"):
        files.read_pose_csv(spark, f"{tmp_path}/b.csv").collect()


@pytest.mark.parametrize("packed", [True, False])
def test_depth_files(spark, tmp_path, packed):
    r = np.random.default_rng(6)
    depth, sky = r.uniform(0, 50, (4, 3, 5)).astype(np.float16), r.random((4, 3, 5)) > 0.5
    depth[1] = -depth[0]  # differences beyond 16 bits wrap
    plain = {"frame_indices": np.arange(0, 8, 2, dtype=np.int32), "is_metric": np.array(True)}
    buffer = io.BytesIO()
    if packed:
        bits = depth.view(np.int16)
        np.savez(buffer, _depth_delta_i16=np.diff(bits, axis=0, prepend=np.zeros_like(bits[:1])), _depth_shape=np.array(depth.shape), _depth_dtype=str(depth.dtype), _sky_packed=np.packbits(sky), _sky_shape=np.array(sky.shape), **plain)
        raw = zstandard.ZstdCompressor().compress(buffer.getvalue())
    else:
        np.savez_compressed(buffer, depth=depth, sky=sky, **plain)
        raw = buffer.getvalue()
    (tmp_path / "d.npz").write_bytes(raw)
    got = files.read_depth(spark, f"{tmp_path}/d.npz").orderBy("frame_number").collect()
    assert [x["frame_number"] for x in got] == [0, 2, 4, 6] and all(x["is_metric"] and (x["h"], x["w"]) == (3, 5) for x in got)
    assert (np.array([x["depth"] for x in got], np.float16).reshape(4, 3, 5) == depth).all() and (np.array([x["sky"] for x in got]).reshape(4, 3, 5) == sky).all()


def test_scan_of_folders(spark, tmp_path):
    for name in ("S1/P1/recording_a.mp4/results_recording_a.mp4_body.csv", "S1/P1/recording_a.mp4/depth_recording_a.mp4.npz", "S1/P1/recording_b.mp4/x.txt", "S1/P2/notes.txt", "S2/readme.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    listed = files.listing(spark, str(tmp_path))
    rows = [(r["participant"], r["recording"], r["body"], r["depth"], r["completed"]) for r in files.scan_recordings(listed).collect()]
    assert rows == [("P1", "recording_a.mp4", 1, 1, 2), ("P1", "recording_b.mp4", 0, 0, 0)]
    depth = len(f"file:{tmp_path}".split("/")) + 1
    assert [tuple(r) for r in files.scan_schools(listed, depth).collect()] == [("S1", 1, 2), ("S2", 0, 0)]
    nested = files.snapshot(files.scan_recordings(listed)).collect()
    assert [x["name"] for x in nested[0]["participants"][0]["recordings"]] == ["recording_a.mp4", "recording_b.mp4"]


def test_person_frames_and_settings(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"frame": 1, "persons": [{"keypoints": [[1.001, 2.0, 0.12345]]}, {"keypoints": [[3.0, 4.0, 0.5]]}]}, {"frame": 2, "persons": []}]))
    got = poses.flatten_persons(files.read_person_frames(spark, f"{tmp_path}/p.json")).collect()
    assert [(x["frame"], x["person_id"], x["kp"]) for x in got] == [(1, 0, [[1.0, 2.0, 0.123]]), (1, 1, [[3.0, 4.0, 0.5]])]
    (tmp_path / "c.json").write_text('{"a": {"b": 3}}')
    assert files.read_settings(spark, f"{tmp_path}/c.json").select("a.b").first()[0] == 3


def test_a_dataset_of_participants_and_references(spark, tmp_path):
    text = "scorer,a,a\nindividuals,i,i\nbodyparts,nose,nose\ncoords,x,y\nframe_0004,1,2\n"
    one, two = tmp_path / "p/S1/P01QX/recording_P01QX_explain__2.mp4", tmp_path / "r/set_irrelevantDA/pose_estimation/merged_predictions"
    for folder, name in ((one, "results_recording_P01QX_explain__2.mp4_merged.csv"), (two, "results_wave.mp4_merged.csv")):
        folder.mkdir(parents=True)
        (folder / name).write_text(text)
    got = {r["clip_id"]: r for r in files.load_dataset(spark, f"{tmp_path}/p/*/*/recording_*.mp4/results_*_merged.csv", f"{two}/results_*_merged.csv").collect()}
    mine, theirs = got["recording_P01QX_explain__2"], got["wave"]
    assert (mine["school"], mine["participant_id"], mine["category"], mine["is_reference"], mine["fps"]) == ("S1", "P01QX", "explain", False, 30.0)
    assert (theirs["school"], theirs["category"], theirs["is_reference"], theirs["frame_number"]) == (None, "irrelevant", True, 4)


def test_match_tables_name_people(spark):
    matches = spark.createDataFrame([("r", f"c{i}", float(i)) for i in range(4)], "reference_id string, clip_id string, normalized_cost double")
    clips = spark.createDataFrame([("c0", "p0", "S"), ("c1", "p1", "S")], "clip_id string, participant_id string, school string")
    got = match_table(matches, clips, 3).orderBy("rank").collect()
    assert [(r["rank"], r["clip_id"], r["participant_id"]) for r in got] == [(1, "c0", "p0"), (2, "c1", "p1"), (3, "c2", None)]


def test_unknown_references_are_named(spark):
    clips = spark.createDataFrame([("a", True), ("b", False)], "clip_id string, is_reference boolean")
    progress.require_known(clips.filter("is_reference"), clips)
    with pytest.raises(ValueError, match="b"):
        progress.require_known(clips, clips)
