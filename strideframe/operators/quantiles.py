"""Exact quantiles of all groups at once, by refining buckets.

A group's values never meet in one task. A first pass counts them in coarse buckets that follow the order of
values (sign and logarithm), with the least and greatest value of each; the bucket that holds a wanted rank is
found from the counts. Later passes look at the values of the wanted buckets only and cut each into FINE equal parts between its
least and greatest value. What is left then is counted value by value. Counting is combined within
the tasks, so a group of any size sends a few thousand rows of each task at most. All groups and all
wanted ranks share the passes, and nothing runs before the result is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.functions.expr import finite

#: Coarse buckets for each power of two; equal parts of a bucket; how often buckets are cut.
COARSE, FINE, ROUNDS = 32, 8192, 1
#: Below every power of two of a double.
LOWEST = 1100


def _coarse(v: Column) -> Column:
    """A bucket that never falls as the value grows."""
    return F.when(v == 0, F.lit(0)).otherwise((F.signum(v) * (F.floor(F.log2(F.abs(v)) * COARSE) + LOWEST * COARSE)).cast("long"))


def _counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def _holding(counted: DataFrame, wanted: DataFrame | None, path: list[str], places: Column | None = None) -> DataFrame:
    """The buckets that hold a wanted rank: ``path``, place, rank (from the bucket's first value), low, high. Without
    ``wanted``, the ranks are ``places`` of each group's total."""
    outer, last = path[:-1], path[-1]
    w = Window.partitionBy(*outer)
    before = F.coalesce(F.sum("n").over(w.orderBy(last).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = counted.withColumn("before", before)
    if wanted is None:
        rows = rows.withColumn("total", F.sum("n").over(w)).withColumn("w", F.explode(places)).select(*path, "n", "low", "high", "before", "w.place", "w.rank")
    else:
        right = wanted.select(*[F.col(c).alias(f"_{c}") for c in outer], "place", "rank")
        rows = rows.join(right, _same(outer, "_")).drop(*[f"_{c}" for c in outer])
    return rows.filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select(*path, "place", (F.col("rank") - F.col("before")).alias("rank"), "low", "high")


def _same(keys: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in keys:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], rounds: int = ROUNDS) -> DataFrame:
    """``keys``, n and a column for each of ``shares`` (name: share): the quantile of the finite values, linear between the
    two nearest. Groups without a finite value have no row; missing keys are a group of their own. ``rounds`` is how often buckets
    are cut: it changes the work only."""
    at = {name: float(q) for name, q in shares.items()}
    if any(not 0 <= q <= 1 for q in at.values()):
        raise ValueError(f"shares {shares}")
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_"))
    rows = df.select(group.alias("g"), finite(F.col(value).cast("double")).alias("v")).filter("v is not null").withColumn("b0", _coarse(F.col("v")))
    path = ["g", "b0"]
    counted = _counted(rows, path)
    places = F.array(*[
        F.struct(F.lit(f"{k}{side}").alias("place"), f((F.col("total") - 1) * F.lit(q)).cast("long").alias("rank"))
        for k, q in enumerate(at.values()) for side, f in (("a", F.floor), ("b", F.ceil))
    ])
    wanted = _holding(counted, None, path, places)
    sizes = counted.groupBy("g").agg(F.sum("n").alias("n"))
    for k in range(1, rounds + 1):
        buckets = wanted.select(*[F.col(c).alias(f"_{c}") for c in path], "low", "high").distinct()
        cut = F.when(F.col("high") > F.col("low"), F.least(F.lit(FINE - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * FINE))).otherwise(0)
        rows = rows.join(buckets, _same(path, "_")).select(*path, "v", cut.cast("long").alias(f"b{k}"))
        outer, path = path, [*path, f"b{k}"]
        wanted = _holding(_counted(rows, path), wanted.select(*outer, "place", "rank"), path)
    buckets = wanted.select(*[F.col(c).alias(f"_{c}") for c in path]).distinct()
    rows = rows.join(buckets, _same(path, "_")).select(*path, "v")
    found = _holding(_counted(rows, [*path, "v"]), wanted.select(*path, "place", "rank"), [*path, "v"])
    wide = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("of"))  # two rows for each share
    wide = wide.join(sizes.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")))
    out = []
    for k, (name, q) in enumerate(at.items()):
        a, b = F.col("of")[f"{k}a"], F.col("of")[f"{k}b"]
        part = (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
        out.append(F.when(a == b, a).otherwise(a * (1 - part) + b * part).alias(name))
    return wide.select(*[F.col("g")[k].alias(k) for k in keys], "n", *out)


def grouped_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """``keys``, n and the median of the finite values of each group."""
    return grouped_quantiles(df, keys, value, {name: 0.5})
