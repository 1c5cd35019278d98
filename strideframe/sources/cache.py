"""A written cache of parsed clips that is refreshed by what has changed.

A refresh looks at the listing of the sources and parses only files that are new or whose time of change is another than the
cached one. What it parses becomes a batch: a folder that counts once Spark has committed it. Of each file the latest
committed batch holds. A refresh that is cut off leaves a folder without a mark, which the next refresh
writes anew under the same number, so that crashes and repetitions give the same table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = re.compile(r"batch=(\d+)$")


def _filesystem(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, cache: str) -> list[int]:
    """The numbers of the batches that were written to their end."""
    at, fs = _filesystem(spark, cache)
    if not fs.exists(at):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = ((BATCH.search(s.getPath().toString()), s.getPath()) for s in fs.listStatus(at))
    return sorted(int(m[1]) for m, p in found if m and fs.exists(path(p, "_SUCCESS")))


def _batches(spark: SparkSession, cache: str) -> DataFrame | None:
    numbers = committed(spark, cache)
    return spark.read.option("basePath", cache).parquet(*[f"{cache}/batch={n:06d}" for n in numbers]) if numbers else None


def entries(spark: SparkSession, cache: str) -> DataFrame:
    """path, source_mtime and batch: of each cached file the state that counts."""
    every = _batches(spark, cache)
    if every is None:
        return spark.createDataFrame([], "path string, source_mtime timestamp, batch int")
    return every.select("path", "source_mtime", "batch").distinct().groupBy("path").agg(F.max_by("source_mtime", "batch").alias("source_mtime"), F.max("batch").alias("batch"))


def cached(spark: SparkSession, cache: str) -> DataFrame | None:
    """The rows of the cache that count, or None if nothing was ever cached."""
    every = _batches(spark, cache)
    if every is None:
        return None
    latest = entries(spark, cache).select(F.col("path").alias("_path"), F.col("batch").alias("_batch"))
    rows = every.join(latest, (F.col("path") == F.col("_path")) & (F.col("batch") == F.col("_batch")), "left_semi")
    return rows.filter("not _empty").drop("batch", "_empty")


def stale(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Files of ``listing`` (path, modificationTime) that the cache lacks or knows from another time."""
    right = known.select(F.col("path").alias("_path"), F.col("source_mtime").alias("_time"))
    return listing.select("path", "modificationTime").join(right, (F.col("path") == F.col("_path")) & (F.col("modificationTime") == F.col("_time")), "left_anti")


def refresh(spark: SparkSession, listing: DataFrame, cache: str, parse: Callable[[list[str]], DataFrame], force: bool = False, files_a_batch: int = 1000) -> int:
    """Brings the cache up to date and returns how many files were parsed. ``parse`` takes paths and gives rows with their ``path``;
    ``force`` parses all files again. Files go into batches of ``files_a_batch``, each committed by itself; a file without rows is
    remembered too. Files that are gone keep their rows."""
    todo = listing.select("path", "modificationTime") if force else stale(listing, entries(spark, cache))
    names = todo.orderBy("path").collect()  # paths of changed files, not their contents
    for lo in range(0, len(names), files_a_batch):
        part = names[lo : lo + files_a_batch]
        number = 1 + max(committed(spark, cache), default=0)
        times = spark.createDataFrame([(r["path"], r["modificationTime"]) for r in part], "_path string, source_mtime timestamp")
        rows = parse([r["path"] for r in part])
        marked = times.join(rows.withColumn("_there", F.lit(True)), F.col("_path") == F.col("path"), "left")
        marked = marked.select(F.col("_path").alias("path"), *[c for c in rows.columns if c != "path"], "source_mtime", F.col("_there").isNull().alias("_empty"))
        marked.write.mode("overwrite").parquet(f"{cache}/batch={number:06d}")
    return len(names)
