"""Time-warped matching on small series."""

import numpy as np

from strideframe.operators import matching
from strideframe.operators.matching import best_matches, closed_dtw
from strideframe.plans import queries


def plain_dtw(a, b, w):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = np.sqrt((w * (a[i] - b[j]) ** 2).sum()) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_closed_dtw_is_the_plain_recurrence():
    r = np.random.default_rng(1)
    query, windows, w = r.normal(size=(9, 3)), r.normal(size=(4, 13, 3)), np.array([0.2, 0.3, 0.5])
    assert np.allclose(closed_dtw(query, windows, w), [plain_dtw(query, x, w) for x in windows])


def test_an_embedded_query_is_found():
    r = np.random.default_rng(2)
    query = r.normal(size=(20, 2))
    series = r.normal(size=(100, 2))
    series[40:60] = query
    assert best_matches(query, [series], np.ones(2))[0] == (40, 20, 0.0)


def test_a_short_series_has_no_match():
    assert best_matches(np.zeros((20, 1)), [np.zeros((9, 1))], np.ones(1)) == [None]


def test_blocks_give_the_windows_of_whole_clips(spark, monkeypatch):
    """Many groups and blocks, and a reference of more than one clip's length, against each clip scanned whole."""
    monkeypatch.setattr(matching, "MAX_REFERENCE_VALUES", 100, raising=False)  # once the bound of all references together
    monkeypatch.setattr(matching, "BLOCK_STARTS", 16, raising=False)
    monkeypatch.setattr(matching, "GROUP_VALUES", 150, raising=False)
    r = np.random.default_rng(3)
    series = {k: r.normal(size=(n, 2)) for k, n in {0: 20, 1: 7, 2: 33, 3: 90, 4: 150, 5: 9, 6: 40}.items()}
    rows = [(k, f"c{k}", i, 1000 * k + i, k < 3, float(a), float(b)) for k, x in series.items() for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "clip_key long, clip_id string, frame_index int, frame_number long, is_reference boolean, a double, b double")
    got = {(x["reference_id"], x["clip_id"]): x for x in matching.dtw_matches(df, ["a", "b"]).collect()}
    scale = np.concatenate([series[k] for k in range(3)]).std(axis=0)
    want = {}
    for ref in range(3):
        mean, std = series[ref].mean(axis=0), series[ref].std(axis=0)
        w = std / scale / (std / scale).sum()
        for k in range(3, 7):
            if hit := best_matches((series[ref] - mean) / std, [(series[k] - mean) / std], w)[0]:
                want[f"c{ref}", f"c{k}"] = (*hit, 1000 * k + hit[0], 1000 * k + hit[0] + hit[1] - 1)
    assert got.keys() == want.keys()
    for key, (s, n, cost, first, last) in want.items():
        x = got[key]
        assert (x["start"], x["window_length_frames"], x["start_frame"], x["end_frame"]) == (s, n, first, last)
        assert abs(x["normalized_cost"] - cost) < 1e-9


def test_nearest_windows(spark):
    r = np.random.default_rng(4)
    q, w = r.normal(size=(10, 2)), r.normal(size=(60, 2))
    asked = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(q)], "query_id long, u double, v double")
    windows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(w)], "window_index long, u double, v double")
    out = matching.nearest_windows(asked, windows, ["u", "v"], k=4)
    got = {(x["query_id"], x["rank"]): x["window_index"] for x in out.collect()}
    near = np.sqrt(((q[:, None] - w[None]) ** 2).sum(axis=2)).argsort(axis=1)[:, :4]
    assert got == {(i, k + 1): near[i, k] for i in range(10) for k in range(4)}


def test_the_overlay_of_matches_covers_their_windows(spark, sf):
    found = queries.dtw_top_matches(spark, sf).agg({"window_length_frames": "sum"}).first()[0]
    got = queries.dtw_match_overlay(spark, sf).collect()
    assert len(got) == found and {0.0, 1.0} <= {x["progress"] for x in got}


def test_match_tables_name_their_excerpts(spark, sf):
    best = {(r["reference_id"], r["clip_id"]): r for r in queries.dtw_top_matches(spark, sf).collect()}
    got = queries.dtw_match_table(spark, sf).collect()
    assert len(got) == len(best) > 0
    for r in got:
        b = best[r["reference_id"], r["clip_id"]]
        assert (r["rank"], r["start_frame"], r["end_frame"], r["normalized_cost"]) == (b["rank"], b["start_frame"], b["end_frame"], b["normalized_cost"])
        assert r["excerpt"] == f"rank{b['rank']:02d}_{b['clip_key']}_{b['clip_id']}_f{b['start_frame']:05d}-{b['end_frame']:05d}.mp4" and r["school"] == f"S{b['clip_key'] % 7}"


def test_windows_are_no_longer_than_they_need(monkeypatch):
    """Series of two lengths in turn: a block of windows holds those of like room, so few frames beyond their ends are warped."""
    seen = []
    whole = matching.closed_ends
    monkeypatch.setattr(matching, "closed_ends", lambda q, w, *rest: seen.append(w.shape[1] * w.shape[2]) or whole(q, w, *rest))
    r = np.random.default_rng(6)
    series = [r.normal(size=(30 if k % 2 else 80, 1)) for k in range(64)]
    got = best_matches(series[0][:40], series, np.ones(1), block=16)
    needed = sum(min(80, len(x) - s) for x in series for s in range(0, len(x) - 20 + 1, 8))
    assert sum(seen) <= 1.1 * needed
    assert got == [best_matches(series[0][:40], [x], np.ones(1))[0] for x in series]
