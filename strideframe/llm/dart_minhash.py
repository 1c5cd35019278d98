"""Near-duplicates by DartMinHash signatures, banded joining and exact verification.

A text's elements are its distinct five-word shingles. An element that occurs c times weighs the number of
binary digits of c, so what stands once weighs one and a line repeated a hundred times weighs seven. Every
unit of weight of an element is a region of the plane of weights and ranks; hashed darts fall on it as a
Poisson process, the same for every text. A text throws darts up to a rank at which it expects DARTS of
them in total, drops those above its own weights, and each signature coordinate keeps its earliest dart.
Two coordinates agree with the probability of the weighted Jaccard similarity. Texts whose signatures
agree in a band are candidates, and candidates are verified by the weighted Jaccard similarity of their
whole shingle sets.

No band is compared pair by pair. Its members are compared with its pivot; those that may still be similar
to a member of another class meet in a prefix-filtered join over their rarest shingles. Lists of that join which very many
texts share (a template with edits) give out no pairs: their sets are compared inside tasks, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crowded_lists
from .common import byte_slices, discard, keep_rows, staged, trim

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
#: Expected darts: enough that an unfilled coordinate is rare; where one is, twice as many are thrown.
DARTS = int(COORDINATES * (np.log(COORDINATES) + 2))
#: Bytes of text a worker signs at a time.
CHUNK_BYTES = 1_000_000
#: Texts of the prefix join meet by classes of size; a class ends at so many times its least size.
SIZE_STEP = 1.05
WEIGHTINGS = ("log", "count", "binary")

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PRIME = _U(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text of each word) of texts that lie side by side in ``data`` and end at ``stops``.
    Words are runs of digits, letters and bytes beyond ASCII; A-Z count as a-z."""
    low = _LOWER[data]
    word = _IS_WORD[low]
    before = np.concatenate([[False], word[:-1]])
    begins = stops[:-1][(stops[:-1] > 0) & (stops[:-1] < len(data))]
    before[begins] = False  # no word goes on into the next text
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.flatnonzero(word)
    first = np.searchsorted(place, starts)
    sizes = np.diff(np.append(first, len(place)))
    at = np.arange(len(place)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        value = mix(_BYTE[low[place]] + at.astype(np.uint64) * _PRIME)
        hashed = mix(np.add.reduceat(value, first))
    return hashed, np.searchsorted(stops, starts, side="right")


def shingle_sets(data: np.ndarray, stops: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of the distinct shingles, by text and hash. A text of fewer words, but not none, is one shingle."""
    words, owner = word_hashes(data, stops)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(owner, minlength=len(stops))
    first = np.cumsum(counts) - counts
    length = np.minimum(width, counts[owner])
    within = np.arange(len(words)) - first[owner]
    keep = within <= counts[owner] - length
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            total = np.where(j < length, mix(total * _PRIME + padded[j : j + len(words)] + _U(j + 1)), total)
    owner, total = owner[keep], total[keep]
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(total), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    at = np.flatnonzero(new)
    return owner[at], total[at], np.diff(np.append(at, len(total)))


def weights_of(count: np.ndarray, weighting: str) -> np.ndarray:
    """Whole weights of elements by how often they occur."""
    if weighting == "log":
        return np.frexp(count.astype(np.float64))[1].astype(np.int64)
    return count if weighting == "count" else np.ones(len(count), np.int64)


def unit_elements(owner: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the unit regions: an element of weight w gives w. The Jaccard similarity of these
    sets is the weighted Jaccard similarity of the texts."""
    row = np.repeat(np.arange(len(owner)), weight)
    cell = np.arange(len(row)) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        hashed = np.where(cell == 0, element[row], mix(element[row] + cell.astype(np.uint64) * _U(0xD1342543DE82EF95)))
    return owner[row], hashed


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES, darts: int | None = None) -> np.ndarray:
    """(texts, k) darts kept. ``weight`` may be any positive number; a text without elements gets zeros.

    Unit regions of weight [i, i + 1) of an element hold darts whose ranks are the arrivals of a Poisson
    process, each with a place on the weight axis; a dart counts for a text if its place is below the
    element's weight there.
    """
    darts = darts or int(k * (np.log(k) + 2))
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(owner, weight, n)
    todo = np.flatnonzero(total > 0)
    factor = 1.0
    while len(todo):
        wanted = np.zeros(n, bool)
        wanted[todo] = True
        mine = np.flatnonzero(wanted[owner])
        cells = np.ceil(weight[mine]).astype(np.int64)
        row = np.repeat(mine, cells)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
        limit = factor * darts / total[owner[row]]
        rank = np.zeros(len(row))
        with np.errstate(over="ignore"):
            state = mix(element[row] + cell.astype(np.uint64) * _U(0xD1342543DE82EF95))
        got_text, got_rank, got_dart = [], [], []
        live = np.arange(len(row))
        while len(live):
            with np.errstate(over="ignore"):
                state = mix(state + _PRIME)
            rank = rank - np.log(_uniform(state))
            near = rank < limit
            state, rank, limit, live = state[near], rank[near], limit[near], live[near]
            with np.errstate(over="ignore"):
                dart = mix(state ^ _U(0xA0761D6478BD642F))
            place = cell[live] + _uniform(mix(dart))
            hit = place < weight[row[live]]
            got_text.append(owner[row[live[hit]]])
            got_rank.append(rank[hit])
            got_dart.append(dart[hit])
        text, ranks, dart = np.concatenate(got_text), np.concatenate(got_rank), np.concatenate(got_dart)
        slot = text * k + (dart % _U(k)).astype(np.int64)
        order = np.lexsort((ranks, slot))
        slot, dart = slot[order], dart[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        out.reshape(-1)[slot[first]] = dart[first]
        todo = todo[(out[todo] == 0).any(axis=1)]
        factor *= 2
    return out


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    total = np.zeros((len(sig), bands), np.uint64)
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        for j in range(rows):
            total = mix(total * _PRIME + parts[:, :, j])
        return mix(total + np.arange(1, bands + 1, dtype=np.uint64)[None, :])


SIGNED = "row_id long, doc_id long, text_key long, n int, set_hash binary, bands array<long>"


def _digests(owner: np.ndarray, units: np.ndarray, n: int) -> list[bytes]:
    """128 bits for each set."""
    digest = np.zeros((n, 2), np.uint64)
    with np.errstate(over="ignore"):
        for j in (0, 1):
            np.add.at(digest[:, j], owner, mix(units * _U(2 * j + 3) + _U(j)))
    return [x.tobytes() for x in digest]


def _sign(weighting: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, data, stops in byte_slices(batch, "text", CHUNK_BYTES):
                n = part.num_rows
                owner, element, count = shingle_sets(data, stops)
                weight = weights_of(count, weighting)
                bands = band_hashes(signatures(owner, element, weight.astype(np.float64), n))
                owner, units = unit_elements(owner, element, weight)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + n)), part.column("doc_id"), part.column("text_key"), pa.array(np.bincount(owner, minlength=n), pa.int32()),
                    pa.array(_digests(owner, units, n), pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).reshape(-1)), BANDS).cast(pa.list_(pa.int64())),
                ], names=[x.split()[0] for x in SIGNED.split(", ")])
                row += n
        trim()

    return run


def _sets(weighting: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, stops in byte_slices(batch, "text", CHUNK_BYTES):
                n = part.num_rows
                owner, element, count = shingle_sets(data, stops)
                owner, units = unit_elements(owner, element, weights_of(count, weighting))
                ends = np.searchsorted(owner, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_digests(owner, units, n), pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(units.view(np.int64)))],
                    names=["set_hash", "units"],
                )
        trim()

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b): root is the least id of its component.

    Alternates large-star and small-star: a node links its greater neighbours, then its lesser ones, to the
    least node it knows. Both keep components whole, and links only move to lesser nodes. It ends when the
    links are stars, however many rounds that takes, and only short rows move. The least nodes are written
    before they are joined, so a node with very many links is a skewed join that Spark splits.
    """
    down = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _are_stars(down):
        both = down.union(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "least")
        large = staged(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "links")
        discard(down, least)
        least = staged(large.groupBy("a").agg(F.min("b").alias("low")), "least")
        small = large.join(least, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        down = staged(small.union(least).distinct(), "links")
        discard(large, least)
    heads = down.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    alone = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    named = down.select(F.col("a").alias("node"), F.col("b").alias("root")).union(heads)
    return named.union(alone.join(named, "node", "left_anti"))


def _are_stars(down: DataFrame) -> bool:
    """Whether each node of the links (a, b), a > b, has one lesser neighbour, which has none itself."""
    n = down.agg(F.count("*"), F.countDistinct("a")).first()
    return n[0] == n[1] and down.join(down.select(F.col("a").alias("up")), F.col("b") == F.col("up"), "left_semi").isEmpty()


def _measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the exact weighted Jaccard similarity of their sets. A text that many are
    compared with is a skewed join key, which Spark splits: the pairs are a written table and no
    aggregation follows."""
    a, b = (sets.select(F.col("rep").alias(x), F.col("units").alias(f"set_{x}")) for x in ("a", "b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", (common / (F.size("set_a") + F.size("set_b") - common)).alias("similarity"))


def _unsettled(in_band: DataFrame, measured: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """(rep, n, root) of the texts that may be similar to a text of another class with which they share a band.

    Jaccard distance is a metric, so two texts whose distances to the pivot of their band differ by more
    than 1 - threshold cannot be similar. Distances fall into steps of that width; a text is settled if
    its own step and the two beside it hold its own class only.
    """
    slack = 1 - threshold + 1e-6
    placed = staged(
        in_band.filter("rep <> pivot").join(measured.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), "similarity"), ["pivot", "rep"])
        .join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
        .select("band", "rep", "n", F.coalesce("root", "rep").alias("root"), F.floor((1 - F.col("similarity")) / slack).alias("step")),
        "placed",
    )
    steps = placed.groupBy("band", "step").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    near = steps.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    near = staged(near.groupBy("band", "step").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high"), "mixed-steps")
    out = staged(placed.join(near, ["band", "step"]).select("rep", "n", "root").distinct(), "unsettled")
    discard(placed, near)
    return out


def _up(c: Column) -> Column:
    return F.ceil(c - 1e-9)


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / float(np.log(SIZE_STEP)) + 1e-9).cast("int")


def prefixes(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The necessary prefixes of ``sets`` (rep, n, units), for the lesser and for the greater text of a pair.

    Units are ordered by rarity among the sets. Two sets of sizes m <= n with a similarity of at least t
    have t / (1 + t) * (m + n) units in common, so the first of these stands early enough in both to leave
    room for the rest: that bounds the prefix of the lesser one by its own size, and of the greater one
    by the least size of the other's class.
    """
    t = threshold / (1 + threshold)
    units = staged(sets.select("rep", "n", F.explode("units").alias("unit")), "units")
    shared = staged(units.groupBy("unit").agg(F.count("*").alias("df")).filter("df > 1"), "shared-units")
    listed = units.join(shared, "unit").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "unit"))).alias("list"))
    # units of one text alone come first and meet nothing
    rows = listed.select("rep", "n", (F.col("n") - F.size("list")).alias("alone"), F.posexplode("list").alias("at", "u"))
    rows = staged(
        rows.select("rep", "n", (F.col("alone") + F.col("at")).alias("pos"), "u.unit").filter(F.col("pos") <= F.col("n") - _up(threshold * F.col("n"))), "prefixes"
    )
    discard(units, shared)
    lesser = rows.filter(F.col("pos") <= F.col("n") - _up(2 * t * F.col("n"))).withColumn("size_class", _size_class(F.col("n")))
    classes = F.sequence(_size_class(threshold * F.col("n")), _size_class(F.col("n")))
    greater = rows.withColumn("size_class", F.explode(classes))
    least = F.greatest(F.pow(F.lit(SIZE_STEP), F.col("size_class")) * (1 - 1e-6), threshold * F.col("n"))
    return lesser, greater.filter(F.col("pos") <= F.col("n") - _up(t * (F.col("n") + least)))


def _candidates(lesser: DataFrame, greater: DataFrame, roots: DataFrame, threshold: float, hubs: bool) -> DataFrame:
    """Pairs (a, b) of different classes that share a unit of their prefixes and pass the length and
    position bounds; with ``hubs``, only pairs with the least text of each unit and class of sizes."""
    t = threshold / (1 + threshold)
    named = lambda df, x: df.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "unit", "size_class", F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("pos").alias(f"pos_{x}"), F.coalesce("root", "rep").alias(f"root_{x}")
    )
    a, b = named(lesser, "a"), named(greater, "b")
    if hubs:
        a = a.groupBy("unit", "size_class").agg(F.min(F.struct("a", "n_a", "pos_a", "root_a")).alias("hub")).select("unit", "size_class", "hub.*")
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    ok = (
        (F.col("root_a") != F.col("root_b")) & ((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
        & (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (room >= t * (F.col("n_a") + F.col("n_b")) - 1e-9)
    )
    return a.join(b, ["unit", "size_class"]).filter(ok).select("a", "b").distinct()


def _classes(in_band: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, root) of the representatives that have links."""
    linked = F.col("similarity") >= threshold - 1e-9
    pairs = staged(in_band.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "pivot-pairs")
    measured = staged(_measure(pairs, sets), "measured")
    links = staged(measured.filter(linked).select("a", "b"), "pivot-links")
    roots = staged(components(links), "roots")
    open_reps = _unsettled(in_band, measured, roots, threshold)
    discard(pairs, measured)
    if open_reps.isEmpty():
        return roots
    lesser, greater = prefixes(open_reps.select("rep", "n").join(sets, "rep"), threshold)
    for hubs in (True, False):  # first stars, which settle most; then whatever is still apart
        if not hubs:  # lists that very many share are compared inside tasks
            full = crowded_lists.crowded_lists(lesser, greater, roots)
            if not full.isEmpty():
                joined = crowded_lists.links_of_lists(full, lesser, greater, sets, roots, threshold)
                links = staged(links.union(joined), "more-links")
                roots = staged(components(links), "roots")
                lesser, greater = (df.join(full, ["unit", "size_class"], "left_anti") for df in (lesser, greater))
        more = staged(_candidates(lesser, greater, roots, threshold, hubs), "candidates")
        if not more.isEmpty():
            links = staged(links.union(_measure(more, sets).filter(linked).select("a", "b")), "more-links")
            roots = staged(components(links), "roots")
        discard(more)
    return roots


def judged(docs: DataFrame, threshold: float = SIMILARITY, weighting: str = "log") -> DataFrame:
    """What ``near_duplicates`` returns, with ``text_key``, a hash of each row's text."""
    if weighting not in WEIGHTINGS:
        raise ValueError(f"weighting {weighting}")
    signed = staged(_texts(docs).mapInArrow(_sign(weighting), SIGNED), "signatures")
    worded = signed.filter("n > 0")
    reps = staged(worded.groupBy("set_hash").agg(F.min(F.struct("row_id", "doc_id", "text_key", "n", "bands")).alias("r")).select("set_hash", F.col("r.row_id").alias("rep"), "r.*"), "representatives")
    member = reps.select("rep", "n", F.explode("bands").alias("band"))
    crowded = staged(member.groupBy("band").agg(F.count("*").alias("met")).filter("met > 1"), "crowded-bands")
    in_crowd = staged(member.join(crowded, "band"), "crowd")
    meets = in_crowd.groupBy("rep").agg(F.sum("met").alias("meets"))
    pivots = staged(in_crowd.join(meets, "rep").groupBy("band").agg(F.max_by("rep", F.struct("meets", -F.col("rep"))).alias("pivot")), "pivots")
    in_band = staged(in_crowd.select("band", "rep", "n").join(pivots, "band"), "band-members")
    wanted = staged(reps.join(in_band.select("rep").distinct(), "rep").select("rep", "set_hash", "doc_id", "text_key"), "wanted")
    discard(crowded, in_crowd, pivots)
    texts = _texts(docs).alias("t").join(
        wanted.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key")).distinct(),
        F.col("t.doc_id").eqNullSafe(F.col("w_id")) & (F.col("t.text_key") == F.col("w_key")), "left_semi",
    ).select("text")
    found = texts.mapInArrow(_sets(weighting), "set_hash binary, units array<long>").groupBy("set_hash").agg(F.first("units").alias("units"))
    sets = staged(found.join(wanted.select("rep", "set_hash"), "set_hash").select("rep", "units"), "shingle-sets")
    roots = _classes(in_band, sets, threshold)
    discard(in_band, wanted, sets)
    named = worded.select("row_id", "doc_id", "text_key", "set_hash").join(
        reps.select("set_hash", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("set_hash", F.coalesce("root", "rep").alias("root")), "set_hash"
    )
    named = staged(named.drop("set_hash"), "named")
    sizes = staged(named.groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "row_id")).alias("keep")
    ), "classes")
    result = named.join(sizes, "root").select("doc_id", "class_id", "class_size", (F.col("row_id") == F.col("keep.row_id")).alias("kept"), "text_key")
    alone = signed.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "text_key")
    return result.union(alone)


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, weighting: str = "log") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept.

    A class is a connected component of texts linked by a weighted Jaccard similarity of ``threshold`` or
    more; class_id is its least doc_id. Of each class exactly one row is ``kept``: the first of the least
    doc_id. Texts without words (null and empty ones too) are classes of their own and kept. Every row is
    judged by its own text: rows of one id, and rows without an id, may lie in different classes, and the
    class_id of a class without any id is null. Copies of one shingle set stand as one text. No link
    between texts that share a band is lost. An empty table gives an empty result; other columns are
    ignored. ``weighting`` of a shingle that occurs c times: "log" (the binary digits of c), "count" (c) or
    "binary" (1), in the signatures and in the verification.

    The operator runs Spark jobs when it is called; what is left to do when its result is read is a join.
    """
    return judged(docs, threshold, weighting).drop("text_key")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all columns.

    Rows are told apart by id and text; of wholly equal rows of those one stays. Texts without words all
    stay. Null ids, empty tables and columns of any other name are allowed.
    """
    return keep_rows(docs, judged(docs))
