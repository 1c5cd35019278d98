"""Nearest neighbours by the index of cells, against all distances."""

import numpy as np
import pytest

from strideframe.operators import spatial


def scattered(seed, n, d=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[: n // 3] = x[: n // 3] * 1e-3 + 2  # a dense spot
    x[n // 3 : n // 2] = x[0]  # very many points at one place
    return x


def frames(spark, q, w):
    axes = "abc"[: w.shape[1]]
    schema = lambda key: f"{key} long, " + ", ".join(f"{a} double" for a in axes)
    make = lambda x, key: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], schema(key))
    return make(q, "query_id"), make(w, "window_index"), list(axes)


@pytest.mark.parametrize("d, k, cell", [(2, 5, 16), (1, 3, 10), (3, 7, 32), (2, 40, 8), (2, 3, 10**6)])
def test_nearest_is_exact(spark, d, k, cell):
    w = scattered(d, 600, d)
    q = np.concatenate([scattered(9, 20, d), w[:3], np.full((1, d), 50.0), np.full((1, d), -50.0)])
    asked, windows, axes = frames(spark, q, w)
    got = {(r["query_id"], r["rank"]): (r["window_index"], r["distance"]) for r in spatial.nearest(asked, windows, axes, k, ["window_index"], cell).collect()}
    far = np.sqrt(((q[:, None] - w[None]) ** 2).sum(axis=2))
    want = {(i, j + 1): (int(p), far[i, p]) for i in range(len(q)) for j, p in enumerate(np.lexsort((np.arange(len(w)), far[i]))[:k])}
    assert got.keys() == want.keys()
    for key, (p, distance) in want.items():
        assert got[key][1] == pytest.approx(distance) and (got[key][0] == p or far[key[0], got[key][0]] == pytest.approx(distance, rel=1e-12))


def test_hard_points(spark):
    nan = float("nan")
    points = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0), (2, None, 1.0), (3, nan, 1.0), (4, 3.0, 4.0)], "window_index long, a double, b double")
    asked = spark.createDataFrame([(7, 0.0, 0.0), (8, None, 0.0)], "query_id long, a double, b double")
    got = [(r["query_id"], r["rank"], r["window_index"], r["distance"]) for r in spatial.nearest(asked, points, ["a", "b"], 10, ["window_index"]).orderBy("rank").collect()]
    assert got == [(7, 1, 1, 0.0), (7, 2, 1, 0.0), (7, 3, 4, 5.0)]
    assert spatial.nearest(asked, points.limit(0), ["a", "b"], 3, ["window_index"]).count() == 0
    assert spatial.nearest(asked.limit(0), points, ["a", "b"], 3, ["window_index"]).count() == 0


def test_pairs_grow_in_proportion(spark):
    """With a query for each hundredth point, four times the points give about four times the pairs, not sixteen."""
    looked = []
    for n in (4_000, 16_000, 64_000):
        table = spark.range(0, n, 1, 4).selectExpr("id AS window_index", "sin(id * 12.9898) * 43758.5453 AS s").selectExpr("window_index", "s - floor(s) AS a", "s * 7 - floor(s * 7) AS b")
        asked = table.filter("window_index % 100 = 0").selectExpr("window_index AS query_id", "a", "b")
        looked.append(spatial.candidate_pairs(asked, table, ["a", "b"], 10, ["window_index"], 64).count())
        assert looked[-1] < n / 100 * 64 * 40
    assert looked[1] < 6 * looked[0] and looked[2] < 6 * looked[1]
