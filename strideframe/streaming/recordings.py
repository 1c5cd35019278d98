"""Runs over recordings as they arrive: each micro-batch of new files is worked off and written under its number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FILES = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, folder: str, out: str, work: Callable[[list[str]], DataFrame], checkpoint: str, glob: str = "*.csv", files_a_batch: int = 1000) -> int:
    """Applies ``work`` (paths to rows: parsing, lifting, fitting) to the files below ``folder`` that no earlier run has seen and returns how many
    batches that took. Batch k is the folder ``batch=k`` of ``out``: a batch that is run again after a crash, by the number Spark has given it,
    replaces what was left of it. Both folders must be shared by all executors. Contents are read by ``work`` alone.
    """
    done = []

    def batch(listing: DataFrame, number: int) -> None:
        paths = sorted(r["path"] for r in listing.select("path").collect())  # files_a_batch at most
        if paths:
            work(paths).write.mode("overwrite").parquet(f"{out}/batch={number:06d}")
            done.append(number)

    found = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    files = found.option("maxFilesPerTrigger", files_a_batch).load(folder).select("path")
    files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)
