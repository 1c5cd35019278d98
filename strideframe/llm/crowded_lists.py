"""Similar sets among those that share a very common element, compared list by list inside tasks.

A prefix-filtered join gives out a row for every two sets that share a prefix element. Where very many share one, such as the
texts of one template, nearly all of these rows come to nothing. Here the whole sets of a list meet in tasks instead:
a list is dealt into blocks of bounded size, every two blocks of it meet once, and what leaves a task are no
pairs but, for each set that is similar to one of another class, a link to one set of its local component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, trim

#: Pairs of a list from which it counts as crowded: below, its pairs are given out.
CROWDED_PAIRS = 4_096
#: Elements and sets of a block at most, on average.
BLOCK_UNITS, BLOCK_SETS = 500_000, 4_096
#: Elements that more than this share of a block's sets hold are counted by matrices, the others by their lists.
DENSE_SHARE = 1 / 8
ROWS_AT_ONCE, COUNTS_AT_ONCE = 512, 2_000_000

LINKS = "a long, b long"


def merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Joins the components of the pairs (i, j); every entry of ``parent`` is the least member of its component."""
    while True:
        a, b = parent[i], parent[j]
        open_pairs = a != b
        if not open_pairs.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[open_pairs], np.minimum(a, b)[open_pairs])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) how many elements each two sets have in common. Sets hold an element once."""
    sizes = np.array([len(x) for x in [*left, *right]], np.int64)
    _, code, count = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    dense = count > max(2, DENSE_SHARE * len(sizes))
    column = np.cumsum(dense) - 1
    mine = dense[code]
    matrix = np.zeros((len(sizes), int(dense.sum())), np.float32)
    matrix[owner[mine], column[code[mine]]] = 1
    out = np.rint(matrix[: len(left)] @ matrix[len(left) :].T).astype(np.int32)
    # elements that few sets hold: of each set of the left, the sets of the right in their lists
    rest = ~mine & (count[code] > 1)
    on_right = rest & (owner >= len(left))
    order = np.argsort(code[on_right], kind="stable")
    listed, key = (owner[on_right] - len(left))[order], code[on_right][order]
    on_left = np.flatnonzero(rest & (owner < len(left)))
    lo, hi = np.searchsorted(key, code[on_left]), np.searchsorted(key, code[on_left], side="right")
    ends = np.cumsum(hi - lo)
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + COUNTS_AT_ONCE, side="right")))
        low, span = lo[first:last], (hi - lo)[first:last]
        at = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(low, span)
        cell = np.repeat(owner[on_left[first:last]], span) * len(right) + listed[at]
        out += np.bincount(cell, minlength=out.size).reshape(out.shape).astype(np.int32)
        first = last
    return out


def _compare(threshold: float):
    def links(table: pa.Table) -> pa.Table:
        rep, root = (table.column(c).to_numpy() for c in ("rep", "root"))
        lesser = table.column("lesser").to_numpy(zero_copy_only=False)
        units = table.column("units").combine_chunks()
        units = units.chunk(0) if isinstance(units, pa.ChunkedArray) else units
        values, ends = units.values.to_numpy(), units.offsets.to_numpy()
        sets = [values[ends[i] : ends[i + 1]] for i in range(len(rep))]
        size = np.diff(ends)
        a, b = np.flatnonzero(lesser), np.flatnonzero(~lesser)
        parent, linked = np.arange(len(rep)), np.zeros(len(rep), bool)
        for lo in range(0, len(a) if len(b) else 0, ROWS_AT_ONCE):
            rows = a[lo : lo + ROWS_AT_ONCE]
            common = common_counts([sets[i] for i in rows], [sets[j] for j in b])
            similar = common >= (threshold - 1e-9) * (size[rows][:, None] + size[b][None, :] - common)
            i, j = np.nonzero(similar & (root[rows][:, None] != root[b][None, :]))
            if len(i):
                parent = merge(parent, rows[i], b[j])
                linked[rows[i]] = linked[b[j]] = True
        some = np.flatnonzero(linked)
        return pa.table([pa.array(rep[some]), pa.array(rep[parent[some]])], names=["a", "b"])

    def run(table: pa.Table) -> pa.Table:
        out = links(table)
        trim()  # what the comparison has used goes back before other stages run
        return out

    return run


def crowded_lists(lesser: DataFrame, greater: DataFrame, roots: DataFrame, pairs: int = CROWDED_PAIRS) -> DataFrame:
    """unit, size_class and blocks of the crowded lists with more than one class among rows (unit, size_class, rep, n)."""
    def sizes(df: DataFrame, c: str) -> DataFrame:
        named = df.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        return named.groupBy("unit", "size_class").agg(F.count("*").alias(c), F.sum("n").alias(f"{c}_units"), F.min("root").alias(f"{c}_low"), F.max("root").alias(f"{c}_high"))

    met = sizes(lesser, "na").join(sizes(greater, "nb"), ["unit", "size_class"]).filter(F.col("na") * F.col("nb") > pairs)
    met = met.filter(F.least("na_low", "nb_low") < F.greatest("na_high", "nb_high"))
    blocks = F.greatest(F.ceil((F.col("na_units") + F.col("nb_units")) / (2 * BLOCK_UNITS)), F.ceil(F.greatest("na", "nb") / BLOCK_SETS)).cast("int")
    return staged(met.select("unit", "size_class", blocks.alias("blocks")), "crowded-lists")


def links_of_lists(lists: DataFrame, lesser: DataFrame, greater: DataFrame, sets: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join the classes of all similar sets of different classes that meet in ``lists``."""
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = lesser.join(lists, ["unit", "size_class"]).select("unit", "size_class", "rep", own.alias("i"), every.alias("j"), F.lit(True).alias("lesser"))
    other = greater.join(lists, ["unit", "size_class"]).select("unit", "size_class", "rep", every.alias("i"), own.alias("j"), F.lit(False).alias("lesser"))
    placed = staged(rows.union(other), "list-members")
    named = placed.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    met = named.join(sets.select("rep", "units"), "rep")
    out = staged(met.groupBy("unit", "size_class", "i", "j").applyInArrow(_compare(threshold), LINKS).distinct(), "list-links")
    discard(placed)
    return out
