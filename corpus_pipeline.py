"""A corpus pipeline: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next stage's docs. All stages but the last return the
columns of documents, whatever else they are named, and empty tables give empty ones. Ids may be missing or
repeated: every row is judged by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strideframe.llm.common import staged, table
from strideframe.llm.dart_minhash import keep_one_of_each
from strideframe.llm.decontamination import drop_contaminated
from strideframe.llm.exact_dedup import keep_one
from strideframe.llm.language_id import keep_identified
from strideframe.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined. Null texts and texts without a letter go, repeated rows are judged each for itself."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of wholly equal rows too. Null counts as empty, and empty texts are equal."""
    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the first of its least id. Texts without words (null and empty ones) all stay."""
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. Null texts have no words and stay; an empty benchmark drops nothing."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences. Null texts count as empty (one id), repeated rows are packed each for itself."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained network's decisions and a packing are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
