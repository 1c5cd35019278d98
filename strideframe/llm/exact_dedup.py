"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, each partition is sorted externally by Spark,
and neighbours are compared in full. The splitters hold the first SPLITTER_CHARS characters and, for
texts that begin alike, 16 bytes of the digest, so long texts never load the driver; among texts of one
beginning the order is that of these digests, then of the content. A group of copies of any size spreads
over as many partitions as its rows need. The runs at the borders of a partition, two at most, carry
their text, and runs of different partitions are joined where those texts are equal in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, staged, trim

BLANKS = r"[\x20\x09-\x0D]+"
SPLITTER_CHARS = 24
RUNS = "doc_id long, n_cp int, text_sha256 string, text_key long, part int, run long, head boolean, edge boolean, keep_id long, keep_cp int, size long, edge_norm string"
_ROW = ["doc_id", "n_cp", "text_sha256", "text_key"]


def _closed(rows: pa.Table, starts: np.ndarray, part: int, first_run: int, texts: dict[int, str]) -> Iterator[pa.RecordBatch]:
    """Whole runs that begin at ``starts``; ``texts`` has those of border runs."""
    sizes = np.diff(np.append(starts, rows.num_rows))
    run = np.repeat(np.arange(len(starts)), sizes)
    head = np.zeros(rows.num_rows, bool)
    head[starts] = True
    numbers = np.arange(first_run, first_run + len(starts))
    heads = rows.take(pa.array(starts))
    per_run = {
        "edge": pa.array([n in texts for n in numbers.tolist()]), "keep_id": heads["doc_id"], "keep_cp": heads["n_cp"], "size": pa.array(sizes),
    }
    out = {
        **{c: rows[c] for c in _ROW}, "part": pa.array(np.full(len(run), part, np.int32)), "run": pa.array(numbers[run]), "head": pa.array(head),
        **{c: v.take(pa.array(run)) for c, v in per_run.items()},
    }
    norm = [None] * rows.num_rows
    for n, text in texts.items():
        if first_run <= n < first_run + len(starts):
            norm[int(starts[n - first_run])] = text
    yield from pa.table({**out, "edge_norm": pa.array(norm, pa.string())}).combine_chunks().to_batches()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal neighbours of one sorted partition. Rows of a run that is still open are held
    back in short form; texts are held one batch at a time."""
    part, last, n_runs = TaskContext.get().partitionId(), None, 0
    texts: dict[int, str] = {}
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch.column("norm")
        same = np.zeros(len(norm), bool)
        if len(norm) > 1:
            same[1:] = pc.equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
        if last is None:
            texts[0] = norm[0].as_py()
        same[0] = last is not None and norm[0].as_py() == last
        last = norm[len(norm) - 1].as_py()
        n_held = sum(t.num_rows for t in held)
        held.append(pa.table({c: batch.column(c) for c in _ROW}))
        starts = np.flatnonzero(~same)
        if not len(starts):
            continue
        cut = n_held + int(starts[-1])  # the last run stays open
        every = pa.concat_tables(held)
        if cut:
            begins = np.unique(np.concatenate([[0], starts[:-1] + n_held]))
            yield from _closed(every.slice(0, cut), begins, part, n_runs, {k: v for k, v in texts.items() if k < n_runs + len(begins)})
            n_runs += len(begins)
        held = [every.slice(cut)]
    if held:
        yield from _closed(pa.concat_tables(held), np.array([0]), part, n_runs, {n_runs: last})
    trim()


def judged(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """What ``exact_dedup`` returns, with ``text_key``, a hash of each row's text."""
    text = F.coalesce(docs[text_col], F.lit(""))
    base = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.regexp_replace(text, BLANKS, "").alias("norm"), F.char_length(text).alias("n_cp"), F.xxhash64(text).alias("text_key"),
    ).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    order = [F.substring("norm", 1, SPLITTER_CHARS), F.unhex(F.substring("text_sha256", 1, 32))]
    tie = [F.col("n_cp").desc(), F.col("doc_id").asc_nulls_last()]
    rows = staged(
        base.repartitionByRange(*order, *tie).sortWithinPartitions(*order, F.col("norm"), *tie).select("norm", *_ROW).mapInArrow(_runs, RUNS), "content-sort"
    )
    borders = rows.filter("edge and head").select("part", "run", "edge_norm", "keep_id", "keep_cp", "size")
    met = borders.groupBy("edge_norm").agg(
        F.sum("size").alias("all_size"),
        F.max_by(F.struct("keep_id", "part", "run"), F.struct("keep_cp", F.col("keep_id").isNotNull(), -F.col("keep_id"), -F.col("part"))).alias("best"),
    )
    joined_up = borders.select("part", "run", "edge_norm").join(met, "edge_norm").select("part", "run", "all_size", "best")
    joined = rows.join(joined_up, ["part", "run"], "left")
    best_here = (F.col("best.part") == F.col("part")) & (F.col("best.run") == F.col("run"))
    return joined.select(
        "doc_id", F.when(F.col("best").isNull(), F.col("keep_id")).otherwise(F.col("best.keep_id")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"), (F.col("head") & F.coalesce(best_here, F.lit(True))).alias("kept"), "text_sha256", "text_key",
    )


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting blanks ``[\\x20\\x09-\\x0D]``; null counts as empty,
    and empty texts are equal to each other. The row with the most code points, then the smallest id
    stays; rows without an id come after all others, and keep_id is null where such a row stays. Of each
    group, repeated rows too, exactly one row is kept. An empty table gives an empty result; other
    columns are ignored. The sort runs when the operator is called.
    """
    return judged(docs, text_col, id_col).drop("text_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns of ``docs``. Rows are told apart by id and text; of
    wholly equal rows one stays. Null ids, empty tables and columns of any other name are allowed."""
    return keep_rows(docs, judged(docs))
