"""Clips that are whole labels, on a table where a label's vectors lie in several ranges of ids."""

import duckdb
import pytest
from pyspark.sql import functions as F

from strideframe.operators import runs
from strideframe.plans.registry import oracle_sql, queries

TABLES = "/root/testdata/sf0.1"


def test_frame_signals_3d_measures_whole_labels(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{TABLES}/embeddings.parquet'")
    labels = {r[0] for r in con.execute("SELECT DISTINCT label FROM embeddings").fetchall()}
    df = queries()["frame_signals_3d"](spark, TABLES)
    cols = sorted(df.columns)
    got = {r["frame_number"]: tuple(r) for r in df.select(*cols).collect()}
    assert {r[cols.index("clip_key")] for r in got.values()} == labels
    for row in con.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()['frame_signals_3d']})").fetchall():
        assert got[row[cols.index("frame_number")]] == row
    spark.catalog.clearCache()


def test_lift_run_lifts_whole_labels(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{TABLES}/embeddings.parquet'")
    df = queries()["lift_run"](spark, TABLES)
    cols = ["run", "frame_index", "joint", "x", "y", "z", "lik"]
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    assert got == sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()['lift_run']})").fetchall()))
    assert df.select("run").distinct().count() == con.execute("SELECT count(DISTINCT label) FROM embeddings").fetchone()[0]


def test_a_lift_in_blocks_is_the_lift_of_whole_runs(spark):
    """Blocks of seven frames, far shorter than gaps and runs."""
    depth = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 0.5 + ((F.col("frame_number") * 13 + i * 7) % 29) / 40)
    rows = spark.range(120).select((F.col("id") % 2).alias("run"), F.floor(F.col("id") / 2).cast("int").alias("frame_index"), F.col("id").alias("frame_number"))
    at = lambda j, n: (F.col("frame_number") * (3 * j + 5) % n).cast("double")
    kp = F.array(*[F.struct((at(j, 71) / 10).alias("x"), (at(j + 1, 67) / 10).alias("y"), F.lit(0.9).alias("lik")) for j in range(5)])
    rasters = rows.filter("frame_number % 9 <> 0").select("run", "frame_number", F.lit(8).alias("w"), F.lit(8).alias("h"), depth.alias("depth"))
    lift = lambda block: sorted(tuple(r) for r in runs.lift_run(rows.withColumn("kp", kp), rasters, [[2, 3, 4]], (0, 1), 8, 8, block=block).na.fill(-1.0).collect())
    whole, cut = lift(None), lift(7)
    assert len(whole) == 600
    assert [r[:3] for r in cut] == [r[:3] for r in whole]
    assert all(a[3:] == pytest.approx(b[3:]) for a, b in zip(cut, whole))
