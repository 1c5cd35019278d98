"""Token files: whole texts encoded, coded with Simple-8b and written in ascending order of id.

A file is a Parquet file of segments. A segment holds a run of documents: their ids, their counts, the
coded words and the first word of each block. Ids of a segment follow those of the one before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import new_path
from .tokens import END_ID, encoder

SEGMENT_DOCS = 512
#: Words a worker keeps while it writes files: learning a word again costs far more than finding it.
LASTING_FILE_WORDS = 1_300_000
#: Stands for a missing id in a file.
NO_ID = -(1 << 63)
SEGMENT_CHARS = 2_000_000
SEGMENT = "part int, seq long, ids_before long, n_ids long, doc_ids binary, counts binary, words binary, block_starts binary"


def chunks(batches: Iterator[pa.RecordBatch], most: int = SEGMENT_DOCS, chars: int = SEGMENT_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Lists of ids and texts (first and second column), bounded in count and in characters."""
    ids, texts, n = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(text)
            n += len(text)
            if len(ids) >= most or n >= chars:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _encoder(vocabulary: str, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(vocabulary, path), TaskContext.get().partitionId(), 0
        enc.most_words = LASTING_FILE_WORDS
        end = np.array([END_ID], np.uint32)
        for seq, (ids, texts) in enumerate(chunks(batches)):
            coded = [np.concatenate([x, end]) for x in enc.encode(texts)]
            flat = np.concatenate(coded)
            words, starts = simple8b.encode(flat)
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()),
                pa.array([np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes()], pa.binary()), pa.array([np.array([len(x) for x in coded], "<u4").tobytes()], pa.binary()),
                pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([starts.astype("<u4").tobytes()], pa.binary()),
            ], names=["part", "seq", "ids_before", "n_ids", "doc_ids", "counts", "words", "block_starts"])
            before += len(flat)

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", tokenizer_path: str | None = None) -> None:
    """Encodes the whole text of every row (null: empty), appends id 2 and writes segments in ascending doc_id order.

    Rows with equal ids are all written, one after the other; rows without an id come last. An empty table writes no segment. Columns other than doc_id and text are ignored.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_encoder(vocabulary, tokenizer_path), SEGMENT)
        .write.parquet(path)
    )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, counts = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["counts"], "<u4").astype(np.int64)
            flat = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["block_starts"], "<u4").astype(np.int64), row["n_ids"]).astype("<u4")
            stops = np.concatenate([[0], np.cumsum(counts)])
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=ids == NO_ID), pa.array(stops[:-1] + row["start"]), pa.array(counts), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with ``start``: the ids of all segments before it. The sums of the parts, one short row each, are broadcast."""
    found = spark.read.schema(SEGMENT).parquet(path)
    sums = found.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    return found.join(F.broadcast(offsets), "part").withColumn("start", F.col("part_start") + F.col("ids_before"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    return (
        read_segments(spark, path)
        .select("n_ids", "doc_ids", "counts", "words", "block_starts", "start")
        .mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def token_table(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", tokenizer_path: str | None = None) -> DataFrame:
    """Writes the files to the shared folder, reads them back and digests each row of ``docs``: doc_id, start,
    n_tokens, ids_crc32. Nulls, repeated rows and empty tables as ``write_token_files`` says; a null id is read back
    as null. The files are written when the operator is called."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocabulary, tokenizer_path)
    return token_digest(docs.sparkSession, path)
