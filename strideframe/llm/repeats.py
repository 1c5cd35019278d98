"""Removal of repeated substrings by longest-previous-factor arrays.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id, or
earlier in the same document. Every such string is filed under its anchor, the least hash among its
grams of GRAM bytes (leftmost on ties), which depends on the string alone. Strings of one anchor
occurrence are neighbours and form a segment. Segments are sorted by anchor and content over the
cluster, so equal ones (128 bits of hashes) lie side by side whatever their number, and all but the first
are removed whole.

Different segments of one anchor are put in suffix order, and the nearest smaller positions before and
behind each suffix give its longest previous factor: where that reaches LENGTH, the string is a later copy.
Anchors with few segments are sorted in a task. Of the others, a task takes the segments of one anchor, or a part of those of a
very large one, and gives out equal strings as spans; only the first strings of such parts are sorted by their bytes over the
cluster, split wherever a partition is full, so no group overloads a task and no repeated string is sent around.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, discard, staged, trim
from .dart_minhash import mix

LENGTH = 100
GRAM = 36
#: Different segments of one anchor that one task puts in suffix order; beyond it the cluster does.
LARGE_ANCHOR = 500
#: Times as many segments of one anchor are still compared in one task, by hashes and bytes of their strings; an anchor of more is divided.
WHOLE_ANCHOR = 8
CHUNK_BYTES = 1_000_000
#: Bytes whose suffixes are sorted at a time.
SUFFIX_BYTES = 1_000_000

_U = np.uint64
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_P = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_P), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            up, down = np.full(size, _P), np.full(size, _INVERSE)
            up[0] = down[0] = 1
            _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


class _Rolling:
    """Hashes of substrings of one byte array: equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _power_tables(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        with np.errstate(over="ignore"):
            return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def segments(data: np.ndarray, stops: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor hash, segment hash) of the segments of whole texts, which lie side by side
    in ``data`` and end at ``stops``; starts are within the text."""
    ends = stops.astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolling = _Rolling(data)
    hashes = rolling.grams(gram)
    w = length - gram + 1
    # the place is in the low bits, so the least key is the least hash and, of equal ones, the leftmost
    key = ((hashes >> _U(32)) << _U(32)) | np.arange(len(hashes), dtype=np.uint64)
    low, p = key, 1
    while 2 * p <= w:
        low = np.minimum(low[:-p], low[p:])
        p *= 2
    n = len(hashes) - w + 1
    low = np.minimum(low[:n], low[w - p : w - p + n])
    owner = np.repeat(np.arange(len(sizes)), sizes)[:n]
    whole = np.arange(n) + length <= ends[owner]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = (low[starts] & _U(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])
    at = np.flatnonzero(new)
    first, last, anchor = starts[at], starts[np.append(at[1:], len(starts)) - 1], anchor[at]
    text = owner[first]
    begin = ends[text] - sizes[text]
    # where the anchor stands in the segment is part of what two segments share
    with np.errstate(over="ignore"):
        content = mix(rolling.of(first, last + length) + (anchor - first).astype(np.uint64) * _P + (last - first).astype(np.uint64))
    return text, first - begin, last - begin, hashes[anchor], content


SEGMENT = "anchor long, content long, doc_id long, place long"


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place: first start, then the number of starts less one in the low 8 bits."""
    for batch in batches:
        for part, data, stops in byte_slices(batch, "text", CHUNK_BYTES):
            text, first, last, anchor, content = segments(data, stops)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[text].astype(np.int64)), pa.array(first << 8 | (last - first))],
                names=["anchor", "content", "doc_id", "place"],
            )
    trim()


FILED = "part int, anchor long, content long, doc_id long, place long, first boolean, several boolean, border int"


def _side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of anchors that occur more than once in a sorted partition, and all rows of its first and last
    anchor (border 1 and 2, 3 for both). first: no equal segment stands before; several: the anchor has
    different segments here. Rows of an anchor are held until it ends or a batch of one anchor is full."""
    part, begun = TaskContext.get().partitionId(), False
    held = [np.zeros(0, np.int64) for _ in range(4)]
    before: tuple[int, int] | None = None  # anchor and content of the last row given out
    mixed = False  # whether the anchor of ``before`` has shown different segments

    def give(cols: list[np.ndarray], final: bool) -> pa.RecordBatch | None:
        nonlocal begun, before, mixed
        a, c = cols[0], cols[1]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        same_as_before = before is not None and a[0] == before[0]
        at = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        first = np.ones(len(a), bool)
        first[1:] = new[1:] | (c[1:] != c[:-1])
        if same_as_before and c[0] == before[1]:
            first[0] = False
        size = np.diff(np.append(at, len(a)))
        kinds = np.add.reduceat(first.astype(np.int64), at)
        several = kinds > 1
        if same_as_before:
            several[0] |= mixed or kinds[0] > 0
        border = np.zeros(len(at), np.int32)
        if not begun or (same_as_before and give.first_run):
            border[0] |= 1
        give.first_run = (not begun or (same_as_before and give.first_run)) and len(at) == 1
        begun = True
        open_run = same_as_before
        if final:
            border[-1] |= 2
        mixed = bool(several[-1])
        before = (int(a[-1]), int(c[-1]))
        wanted = (size > 1) | (border > 0)
        if open_run:
            wanted[0] = True
        if give.carry:  # the rest of this anchor is still to come
            wanted[-1] = several[-1] = True
        keep = wanted[run]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(int(keep.sum()), part, np.int32)), *(pa.array(x[keep]) for x in cols), pa.array(first[keep]), pa.array(several[run][keep]), pa.array(border[run][keep])],
            names=[x.split()[0] for x in FILED.split(", ")],
        )

    give.first_run, give.carry = False, False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        give.carry = False
        if cut == 0 and len(cols[0]) > 200_000:  # one anchor fills it: give out all but the last row
            cut, give.carry = len(cols[0]) - 1, True
        if cut:
            yield give([x[:cut] for x in cols], False)
        held = [x[cut:] for x in cols]
    if len(held[0]):
        give.carry = False
        yield give(held, True)


def _borders(rows: DataFrame) -> DataFrame:
    """For each part: whether its first anchor, and its first segment, go on from the part before, and
    whether its last anchor goes on in the next; and whether the anchors there have different segments."""
    order = ["anchor", "content"]
    first = rows.filter("border in (1, 3)").groupBy("part").agg(F.min(F.struct(*order)).alias("head"), F.max("several").alias("head_several"))
    last = rows.filter("border in (2, 3)").groupBy("part").agg(F.max(F.struct(*order)).alias("tail"), F.max("several").alias("tail_several"))
    by_part = Window.orderBy("part")  # one row a part
    joined = first.join(last, "part", "full")
    prev, nxt = F.lag("tail").over(by_part), F.lead("head").over(by_part)
    return joined.select(
        "part", F.col("head.content").alias("head_content"),
        F.coalesce(prev["anchor"] == F.col("head.anchor"), F.lit(False)).alias("from_before"),
        F.coalesce(prev == F.col("head"), F.lit(False)).alias("same_segment"),
        F.coalesce(nxt["anchor"] == F.col("tail.anchor"), F.lit(False)).alias("into_next"),
    )


def _cut_out(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, docs, starts, parts, dealt = [], [], [], [], []
            for doc_id, text, wanted in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "wanted"))):
                raw = text.encode()
                for w in wanted:
                    first, more = w["place"] >> 8, w["place"] & 255
                    anchors.append(w["anchor"])
                    docs.append(doc_id)
                    starts.append(first)
                    parts.append(raw[first : first + more + length])
                    dealt.append(w["parts"])
                if len(parts) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary()), pa.array(dealt, pa.int64())], names=["anchor", "doc_id", "start", "bytes", "parts"])
                    anchors, docs, starts, parts, dealt = [], [], [], [], []
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary()), pa.array(dealt, pa.int64())], names=["anchor", "doc_id", "start", "bytes", "parts"])

    return run


def suffix_levels(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(n, rank of each position by its next n bytes, zeros after the end) for n = 8, 16, ... and ``length``, by prefix doubling."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(data), np.uint64)
    for i in range(min(8, length)):
        word = (word << _U(8)) | padded[i : i + len(data)]
    known = min(8, length)
    levels = [(known, np.unique(word, return_inverse=True)[1].astype(np.uint32))]
    while known < length:
        step, rank = min(known, length - known), levels[-1][1]
        ahead = np.concatenate([rank[step:] + np.uint32(1), np.zeros(min(step, len(rank)), np.uint32)])[: len(rank)]
        known += step
        levels.append((known, np.unique(rank.astype(np.uint64) << _U(32) | ahead, return_inverse=True)[1].astype(np.uint32)))
    return levels


def common_prefixes(data: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the suffixes at ``a`` and at ``b`` share, at most ``length``, of which all have as many left."""
    full = levels[-1][1][a] == levels[-1][1][b]
    shared = np.where(full, length, 0)
    open_ = np.flatnonzero(~full)
    for n, rank in levels[-2::-1]:
        x, y = a[open_] + shared[open_], b[open_] + shared[open_]
        fits = shared[open_] + n <= length
        fits[fits] = rank[x[fits]] == rank[y[fits]]
        shared[open_[fits]] += n
    for _ in range(min(7, length)):  # the last bytes
        x, y = a[open_] + shared[open_], b[open_] + shared[open_]
        more = shared[open_] < length
        more[more] = data[x[more]] == data[y[more]]
        open_ = open_[more]
        shared[open_] += 1
    return shared


def _nearest_smaller(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each place in suffix order the bytes it shares with the nearest place before it of a smaller
    position; ``shared`` is what each place shares with the one before it. By pointer jumping: what lies
    between a place and the one it points to has greater positions."""
    n = len(position)
    before, least = np.arange(-1, n - 1), shared.copy()
    open_ = np.flatnonzero(position[before] > position)
    open_ = open_[before[open_] >= 0]
    while len(open_):
        jump = before[open_]
        least[open_] = np.minimum(least[open_], least[jump])
        before[open_] = before[jump]
        open_ = open_[before[open_] >= 0]
        open_ = open_[position[before[open_]] > position[open_]]
    least[before < 0] = 0
    return least


def longest_previous_factors(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each suffix, in suffix order, the most bytes it shares with a suffix of a smaller position: the
    greater one of what it shares with the nearest such suffix before it and behind it."""
    behind = np.append(shared[1:], 0)[::-1]
    return np.maximum(_nearest_smaller(position, shared), _nearest_smaller(position[::-1], behind)[::-1])


def later_copies(group: np.ndarray, doc: np.ndarray, start: np.ndarray, parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(part, start) of the strings of ``length`` bytes in ``parts`` with an earlier copy in their group:
    those whose longest previous factor reaches ``length``. Suffixes are ordered by as many bytes, then by position."""
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    levels = suffix_levels(data, length)
    counts = sizes - length + 1
    part = np.repeat(np.arange(len(parts)), counts)
    offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(sizes) - sizes)[part] + offset
    place = np.empty(len(at), np.int64)  # position of each string among all: by document, then start
    place[np.lexsort((start[part] + offset, doc[part]))] = np.arange(len(at))
    order = np.lexsort((place, levels[-1][1][at], group[part]))
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        shared[1:] = common_prefixes(data, levels, at[order[:-1]], at[order[1:]], length)
        shared[1:][group[part[order[1:]]] != group[part[order[:-1]]]] = 0
    late = np.sort(order[longest_previous_factors(place[order], shared) >= length])
    return part[late], start[part[late]] + offset[late]


def _spans(doc: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of neighbouring starts of a document as byte spans."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1 if len(doc) else at
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(start[at]), pa.array(start[last] + length)], names=["doc_id", "a", "b"])


SPAN = "doc_id long, a long, b long"


def _factors(length: int):
    def settle(rows: list[np.ndarray], parts: list[bytes]) -> pa.RecordBatch:
        p, s = later_copies(*rows, parts, length)
        return _spans(rows[1][p], s, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parts, size = [np.zeros(0, np.int64)] * 3, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rows)]
            parts += batch.column(3).to_pylist()
            while True:
                ends = np.cumsum([len(p) for p in parts])
                if not len(ends) or ends[-1] < SUFFIX_BYTES:
                    break
                cut = int(np.searchsorted(ends, SUFFIX_BYTES)) + 1
                cut = int(np.searchsorted(rows[0], rows[0][min(cut, len(parts) - 1)], side="left"))
                if cut == 0:  # one anchor: take it whole if its end is here
                    cut = int(np.searchsorted(rows[0], rows[0][0], side="right"))
                    if cut == len(parts):
                        break
                yield settle([r[:cut] for r in rows], parts[:cut])
                rows, parts = [r[cut:] for r in rows], parts[cut:]
        if parts:
            yield settle(rows, parts)
        trim()

    return run


STRING = "string binary, doc_id long, start long, stop long"
NEIGHBOUR = "part int, doc_id long, start long, later boolean, head boolean, string binary"


def _strings(length: int, most: int):
    """Anchors with very many segments, sorted by anchor: rows with a string are its first occurrence in a chunk, of anchors that lie in several
    ``parts``; rows without one are spans of strings with an earlier copy in the chunk. A chunk holds whole anchors, or parts of a divided one."""

    def settle(rows: list[np.ndarray], parts: list[bytes]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        counts = sizes - length + 1
        part = np.repeat(np.arange(len(parts)), counts)
        offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        at = (np.cumsum(sizes) - sizes)[part] + offset
        doc, start = rows[1][part], rows[2][part] + offset
        order = np.lexsort((start, doc, _Rolling(data).of(at, at + length)))  # equal strings side by side, the earliest first
        views = np.lib.stride_tricks.sliding_window_view(data, length)
        late = np.zeros(len(order), bool)
        for lo in range(1, len(order), 50_000):  # by bytes
            hi = min(lo + 50_000, len(order))
            late[lo:hi] = (views[at[order[lo:hi]]] == views[at[order[lo - 1 : hi - 1]]]).all(axis=1)
        spans = _spans(doc[order[late]], start[order[late]], length)
        first = order[~late]
        first = first[rows[3][part[first]] > 1]
        strings = np.ascontiguousarray(views[at[first]]) if len(first) else np.zeros((0, length), np.uint8)
        column = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.arange(len(first) + 1) * length).astype(np.int32)), pa.py_buffer(strings)])
        n = spans.num_rows
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([column, pa.nulls(n, pa.binary())]), pa.concat_arrays([pa.array(doc[first]), spans.column(0)]),
            pa.concat_arrays([pa.array(start[first]), spans.column(1)]), pa.concat_arrays([pa.array(start[first] + length), spans.column(2)]),
        ], names=["string", "doc_id", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parts = [np.zeros(0, np.int64)] * 4, []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([r, batch.column(x).to_numpy(zero_copy_only=False)]) for r, x in zip(rows, ("anchor", "doc_id", "start", "parts"))]
            parts += batch.column("bytes").to_pylist()
            while len(parts) > 2 * most:
                cut = int(np.searchsorted(rows[0], rows[0][most], side="left")) or int(np.searchsorted(rows[0], rows[0][0], side="right"))
                cut = min(cut, 2 * most)  # only a divided anchor is longer
                yield settle([r[:cut] for r in rows], parts[:cut])
                rows, parts = [r[cut:] for r in rows], parts[cut:]
        if parts:
            yield settle(rows, parts)
        trim()

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of one sorted partition: whether the one before is equal, so that this is a later copy. The first
    row of a partition carries its string as ``head``; its last string comes in a row without a document."""
    part, last = TaskContext.get().partitionId(), None
    head = True  # whether all rows so far equal the first
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        string = batch.column("string")
        later = np.zeros(n, bool)
        if n > 1:
            later[1:] = pc.equal(string.slice(1), string.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        begun = last is not None
        later[0] = begun and string[0].as_py() == last
        last = string[n - 1].as_py()
        heads = np.logical_and.accumulate(later) & head if begun else np.concatenate([[True], np.logical_and.accumulate(later[1:])])
        head = bool(heads[-1])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(n, part, np.int32)), batch.column("doc_id"), batch.column("start"), pa.array(later), pa.array(heads),
            pa.array([string[0].as_py() if not begun else None] + [None] * (n - 1), pa.binary()),
        ], names=[x.split()[0] for x in NEIGHBOUR.split(", ")])
    if last is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([False]), pa.array([False]), pa.array([last], pa.binary())],
            names=[x.split()[0] for x in NEIGHBOUR.split(", ")],
        )
    trim()


def _sorted_over_cluster(strings: DataFrame, length: int) -> DataFrame:
    """Spans of the later copies among (string, doc_id, start): sorted by bytes, then position, a string's
    nearest smaller position is its neighbour before it."""
    order = ["string", "doc_id", "start"]
    rows = staged(strings.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, NEIGHBOUR), "neighbours")
    by_part = Window.orderBy("part")  # one row a partition
    ends = rows.filter("string is not null").groupBy("part").agg(
        F.max(F.when(F.col("doc_id").isNotNull(), F.col("string"))).alias("head_string"), F.max(F.when(F.col("doc_id").isNull(), F.col("string"))).alias("tail_string")
    )
    goes_on = ends.select("part", F.coalesce(F.lag("tail_string").over(by_part) == F.col("head_string"), F.lit(False)).alias("goes_on")).filter("goes_on")
    late = rows.filter("doc_id is not null and (later or head)").join(goes_on, "part", "left")
    late = late.filter(F.col("later") | (F.col("head") & F.coalesce("goes_on", F.lit(False))))
    return late.select("doc_id", F.col("start").alias("a"), (F.col("start") + length).alias("b"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the merged spans of each document."""
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "spans"))):
            raw, kept, at, n_spans, n_removed = text.encode(), [], 0, 0, 0
            for s in spans or ():
                a, b = s["a"], s["b"]
                if a > at or not n_spans:
                    kept.append(raw[at:a])
                    n_spans += 1
                n_removed += max(0, b - max(a, at))
                at = max(at, b)
            kept.append(raw[at:])
            rows.append((doc_id, len(raw), n_removed, n_spans, b"".join(kept)))
        yield _digest_rows(rows)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array([hashlib.sha256(x).hexdigest() for x in cols[4]], pa.string())],
        names=[x.split()[0] for x in RESULT.split(", ")],
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): key is the id, or for rows without one a number beyond all ids from their text."""
    text = F.coalesce(docs["text"], F.lit(""))
    doc_id = docs["doc_id"].cast("long")
    beyond = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 2)
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, beyond).alias("key"), text.alias("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, large_anchor: int = LARGE_ANCHOR) -> DataFrame:
    """Byte spans (key, a, b) that later copies cover; spans of a document may overlap. ``key`` is the doc_id, or
    stands for the text of rows without one."""
    texts = _keyed(docs).select(F.col("key").alias("doc_id"), "text")
    order = ["anchor", "content", "doc_id", "place"]
    rows = staged(
        texts.mapInArrow(_file, SEGMENT).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_side_by_side, FILED), "segments"
    )
    borders = staged(_borders(rows), "borders")  # one row for each sorted partition
    at_head, at_tail = F.col("border").bitwiseAND(1) > 0, F.col("border").bitwiseAND(2) > 0
    goes_on = (at_head & F.coalesce("from_before", F.lit(False))) | (at_tail & F.coalesce("into_next", F.lit(False)))
    later = ~F.col("first") | (at_head & F.coalesce("same_segment", F.lit(False)) & (F.col("content") == F.col("head_content")))
    known = rows.join(borders, "part", "left").select("anchor", "doc_id", "place", later.alias("later"), (F.col("several") | goes_on).alias("several"))
    first, more = F.shiftright("place", 8), F.col("place").bitwiseAND(255)
    copies = staged(known.filter("later").select("doc_id", first.alias("a"), (first + more + length).alias("b")), "copies")
    open_rows = staged(known.filter("not later and several").select("anchor", "doc_id", "place"), "open-segments")
    discard(rows, borders)
    most = max(1, WHOLE_ANCHOR * large_anchor)
    large = staged(open_rows.groupBy("anchor").count().filter(F.col("count") > large_anchor).select("anchor", F.ceil(F.col("count") / most).alias("parts")), "large-anchors")
    wanted = (
        open_rows.join(large, "anchor", "left").groupBy("doc_id")
        .agg(F.collect_list(F.struct("anchor", "place", F.coalesce("parts", F.lit(0)).alias("parts"))).alias("wanted"))
    )
    cut = staged(
        texts.join(wanted, "doc_id").mapInArrow(_cut_out(length), "anchor long, doc_id long, start long, bytes binary, parts long"), "segment-bytes"
    )
    discard(open_rows)
    met = cut.filter("parts = 0").select("anchor", "doc_id", "start", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    found = met.mapInArrow(_factors(length), SPAN)
    if not large.isEmpty():
        dealt = cut.filter("parts > 0").repartition("anchor", F.pmod(F.xxhash64("doc_id", "start"), "parts")).sortWithinPartitions("anchor")
        strings = staged(dealt.mapInArrow(_strings(length, most), STRING), "strings")
        found = found.union(strings.filter("string is null").select("doc_id", F.col("start").alias("a"), F.col("stop").alias("b")))
        found = found.union(_sorted_over_cluster(strings.filter("string is not null").drop("stop"), length))
    spans = staged(copies.union(found).withColumnRenamed("doc_id", "key"), "spans")
    discard(copies, large, cut)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, large_anchor: int = LARGE_ANCHOR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty; texts shorter than ``length`` lose nothing. An id stands for one text, so
    rows that share an id count as one document and lose what any of them repeats. Rows without an id
    come after all others, in the order of a hash of their texts; wholly equal ones count as one document. An
    empty table gives an empty result; other columns are ignored. ``large_anchor`` changes where the
    work is done, not the result. The operator runs Spark jobs when it is called.
    """
    spans = repeated_spans(docs, length, large_anchor)
    by_doc = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return _keyed(docs).join(by_doc, "key", "left").select("doc_id", "text", "spans").mapInArrow(_merge, RESULT)
