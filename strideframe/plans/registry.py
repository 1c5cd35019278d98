"""Query registry of the motion and signal operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strideframe.plans import oracles, recordings
from strideframe.plans import queries as q


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.normalize_per_clip(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**q.QUERIES, **recordings.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**oracles.ORACLES, **recordings.ORACLES}
