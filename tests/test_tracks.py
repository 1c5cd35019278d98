"""Long lifts keep a frame in one row until their end; missing values and NaN as in the form of whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideframe.operators import runs, tracks


def test_medians_leave_out_what_is_missing():
    r = np.random.default_rng(0)
    x, there = r.normal(size=(50, 4, 10)), r.random((50, 4, 10)) < 0.4
    got = tracks.middle(x, there)
    for i in np.ndindex(50, 4):
        some = x[i][there[i]]
        assert got[i] == pytest.approx(np.median(some)) if len(some) else np.isnan(got[i])


def test_a_long_lift_with_missing_values(spark):
    """Frames without a raster, coordinates and likelihoods that are NULL, hands without a likely joint; blocks shorter than gaps. The plan takes
    frames apart once, after the windows."""
    at = lambda j, n: (F.col("frame_number") * (3 * j + 5) % n).cast("double")
    rows = spark.range(150).select((F.col("id") % 2).alias("run"), F.floor(F.col("id") / 2).cast("int").alias("frame_index"), F.col("id").alias("frame_number"))
    lost = lambda j, n: F.when(F.col("frame_number") % n != j, F.lit(1.0))
    kp = F.array(*[F.struct((lost(j, 7) * at(j, 71) / 10).alias("x"), (lost(j, 11) * at(j + 1, 67) / 10).alias("y"), (lost(j, 13) * F.when(at(j, 17) > 9, 0.9).otherwise(0.01)).alias("lik")) for j in range(6)])
    depth = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 0.5 + ((F.col("frame_number") * 13 + i * 7) % 29) / 40)
    rasters = rows.filter("frame_number % 9 > 1 and not frame_number between 40 and 80").select("run", "frame_number", F.lit(8).alias("w"), F.lit(8).alias("h"), depth.alias("depth"))
    lift = lambda block: runs.lift_run(rows.withColumn("kp", kp), rasters, [[2, 3, 4]], (0, 1), 8, 8, block=block)
    long = lift(6)
    whole, cut = (sorted(tuple(r) for r in df.withColumns({c: F.coalesce(c, F.lit(-9.0)) for c in ("x", "y", "z", "lik")}).collect()) for df in (lift(None), long))
    assert len(whole) == 900 and any(r[5] == -9.0 for r in whole)
    assert [r[:3] for r in cut] == [r[:3] for r in whole]
    assert all(a[3:] == pytest.approx(b[3:]) for a, b in zip(cut, whole))
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("FlatMapGroupsInArrow")
    spark.catalog.clearCache()
