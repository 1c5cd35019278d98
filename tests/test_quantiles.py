"""Grouped quantiles against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators.quantiles import grouped_median, grouped_quantiles

SHARES = {"least": 0.0, "q1": 0.01, "half": 0.5, "q3": 0.75, "most": 1.0}


def groups():
    rng = np.random.default_rng(5)
    return {
        "normal": rng.normal(size=700), "ties": rng.integers(-3, 3, 500).astype(float), "one": np.array([4.25]), "two": np.array([-1.0, 5.0]), "zeros": np.zeros(50),
        "wide": rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), "close": 1.7e9 + rng.integers(0, 40, 400) * 2.0**-22, "huge": np.array([-1.7e308, 1.7e308, 1.6e308, 0.0]),
        "tiny": np.array([5e-324, -5e-324, 1e-320, 0.0, -0.0]), None: rng.random(90),
    }


def test_quantiles(spark):
    data = groups()
    rows = [(g, i % 2, float(x)) for g, v in data.items() for i, x in enumerate(v)]
    rows += [("normal", 0, None), ("normal", 0, float("nan")), ("empty", 0, None)]
    df = spark.createDataFrame(rows, "g string, side int, v double").repartition(5)
    got = {r["g"]: r for r in grouped_quantiles(df, ["g"], "v", SHARES).collect()}
    assert got.keys() == data.keys()
    for g, v in data.items():
        assert got[g]["n"] == len(v)
        for name, q in SHARES.items():
            at = (len(v) - 1) * q
            low, high, part = np.sort(v)[int(np.floor(at))], np.sort(v)[int(np.ceil(at))], at - np.floor(at)
            assert got[g][name] == pytest.approx(low if low == high else low * (1 - part) + high * part, rel=1e-12, abs=0), (g, name)
    both = {(r["g"], r["side"]): r["m"] for r in grouped_median(df, ["g", "side"], "v", "m").collect()}
    assert both["normal", 1] == pytest.approx(np.median(data["normal"][1::2]), rel=1e-12) and ("one", 1) not in both
    whole = grouped_median(df, [], "v").collect()
    assert len(whole) == 1 and whole[0]["n"] == sum(map(len, data.values()))


def test_no_rows_and_bad_shares(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert grouped_median(df, ["g"], "v").count() == 0
    with pytest.raises(ValueError):
        grouped_quantiles(df, ["g"], "v", {"x": 1.5})


def test_a_large_group_sends_few_rows(spark):
    """Rows that leave a task are buckets, not values."""
    df = spark.range(0, 400_000, 1, 8).select(F.lit(1).alias("g"), F.pmod(F.col("id") * 7919, F.lit(400_003)).cast("double").alias("v"))
    out = grouped_median(df, ["g"], "v")
    want = float(np.median(np.arange(400_000, dtype=np.int64) * 7919 % 400_003))
    assert out.first()["median"] == want
