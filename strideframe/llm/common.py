"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in ``spark.checkpoint.dir``; only in local mode
    (tests) may that be unset, and a temporary folder is then set for this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="strideframe-")
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_marked: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder, which goes when the application ends."""
    root = f"{shared_dir(spark)}/strideframe/{spark.sparkContext.applicationId}"
    if root not in _marked:
        path, fs = _hadoop_path(spark, root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _marked.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back. It cuts the lineage: what is
    read later no longer depends on any executor's disk, so the shuffle files of the write go when it ends.
    ``discard`` removes the written files early."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for df in tables:
        path, fs = _hadoop_path(df.sparkSession, df._staged_at)
        fs.delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Removes everything this application has staged; call it once the results are written."""
    path, fs = _hadoop_path(spark, f"{shared_dir(spark)}/strideframe/{spark.sparkContext.applicationId}")
    fs.delete(path, True)


def whole_text(col: str = "text"):
    """Null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n: the fold of a row."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def keep_rows(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` (doc_id, text_key, kept; one row per row of ``docs``) keeps, with all
    their columns. Rows of one id and text that are not all kept are cut down to one before any shuffle."""
    keys = judged.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"), F.count_if("kept").alias("kept")).filter("kept > 0")
    keys = staged(keys.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key"), (F.col("rows") > F.col("kept")).alias("k_twice")), "kept-keys")
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    key = F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))
    met = whole.join(keys, F.col("row.doc_id").cast("long").eqNullSafe(F.col("k_id")) & (key == F.col("k_key")))
    one = met.filter("k_twice").groupBy("k_id", "k_key").agg(F.first("row").alias("row")).select("row.*")
    return met.filter("not k_twice").select("row.*").union(one)


def byte_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``most`` bytes of a text column without nulls: (slice, its bytes, where each
    text ends in them). The bytes are those of the batch; nothing is copied."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + batch.num_rows + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo), data[ends[lo] : ends[hi]], ends[lo + 1 : hi + 1] - ends[lo]
        lo = hi


_libc = ctypes.CDLL(ctypes.util.find_library("c")) if ctypes.util.find_library("c") else None


def trim() -> None:
    """Gives memory that a finished task has freed back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
