"""Packing by Karmarkar-Karp multiway differencing.

Whole windows are cut from long documents at once. The rest is gathered into groups of about GROUP_WINDOWS
windows. A small share of a group's documents is set aside as filler; differencing merges partial partitions
of the others with opposing imbalances until all lie, whole, in near-equal windows, and the number of
windows rises whenever one exceeds the capacity. The room left in each window is then filled with slices of
the filler, so only filler documents are cut. What a group leaves over goes into the next one; the last
part-filled window of a task is laid out in lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_files import chunks
from .tokens import END_ID, encoder

CAPACITY = 4096
GROUP_WINDOWS = 16
#: Share of a group that is set aside to fill the room that differencing leaves.
FILLER = 0.03
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` near-equal parts by largest differencing."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, n in enumerate(sizes):
        heap.append((-n, i, [n] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, pa_ = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        merged = sorted(((x + y, i) for i, (x, y) in enumerate(zip(a, reversed(b)))), key=lambda z: (-z[0], z[1]))
        low = merged[-1][0]
        parts = [pa_[i] + pb[k - 1 - i] for _, i in merged]
        heapq.heappush(heap, (-(merged[0][0] - low), order, [x - low for x, _ in merged], parts))
        order += 1
    return heap[0][3] if heap else [[] for _ in range(k)]


Piece = tuple[int, int, int]


def near_equal(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows of whole pieces (document, start, length) of at most ``capacity`` ids, by differencing: as few as hold
    the total, and one more whenever a window is over capacity."""
    sizes = [p[2] for p in pieces]
    k = max(1, -(-sum(sizes) // capacity))
    while pieces:
        windows = [[pieces[i] for i in part] for part in difference(sizes, k)]
        if max(sum(p[2] for p in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        k += 1
    return []


def pack(pieces: list[Piece], capacity: int = CAPACITY, filler_share: float = FILLER) -> tuple[list[list[Piece]], list[Piece]]:
    """(full windows, pieces left over, of less than ``capacity`` ids). Pieces are at most ``capacity`` long."""
    total = sum(p[2] for p in pieces)
    whole, filler, n = list(pieces), [], total
    while whole and n > (1 - filler_share) * total:
        filler.append(whole.pop())
        n -= filler[-1][2]
    windows = sorted(near_equal(whole, capacity), key=lambda w: -sum(p[2] for p in w))
    full: list[list[Piece]] = []
    left = sum(p[2] for p in filler)
    for _ in range(total // capacity):
        window = windows.pop(0) if windows else []
        room = capacity - sum(p[2] for p in window)
        while left < room:  # the emptiest window becomes filler
            given = windows.pop()
            filler += given
            left += sum(p[2] for p in given)
        left -= room
        while room:
            doc, start, n = filler.pop()
            take = min(n, room)
            if take < n:
                filler.append((doc, start + take, n - take))
            window.append((doc, start, take))
            room -= take
        full.append(window)
    return full, [p for w in windows for p in w] + filler


def powers(window: list[Piece], capacity: int = CAPACITY) -> list[list[Piece]]:
    """The pieces of a part-filled window in windows whose lengths are powers of two."""
    out, rest, p = [], list(reversed(window)), capacity
    left = sum(x[2] for x in window)
    while left:
        while p > left:
            p //= 2
        part, need = [], p
        while need:
            doc, start, n = rest.pop()
            take = min(n, need)
            if take < n:
                rest.append((doc, start + take, n - take))
            part.append((doc, start, take))
            need -= take
        out.append(part)
        left -= p
    return out


class _Packer:
    """Groups of one task. It holds the ids of the documents of the open group only."""

    def __init__(self, part: int, capacity: int, windows: int, cut: bool) -> None:
        self.sequence, self.capacity, self.full, self.cut = part << 40, capacity, capacity * windows, cut
        self.pieces: list[Piece] = []
        self.total, self.docs, self.rows = 0, {}, []

    def _emit(self, window: list[Piece]) -> None:
        at = 0
        for doc, start, n in window:
            doc_id, ids = self.docs[doc]
            self.rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), self.sequence, at))
            at += n
        self.sequence += 1

    def add(self, number: int, doc_id, ids: np.ndarray) -> None:
        self.docs[number] = (doc_id, ids)
        n, start = len(ids), 0
        while n - start >= self.capacity:
            self._emit([(number, start, self.capacity)])
            start += self.capacity
        if start == n:
            del self.docs[number]
            return
        self.pieces.append((number, start, n - start))
        self.total += n - start
        if self.total >= self.full:
            self._close()

    def _close(self) -> None:
        windows, self.pieces = pack(self.pieces, self.capacity) if self.cut else (near_equal(self.pieces, self.capacity), [])
        for w in windows:
            self._emit(w)
        self.docs = {doc: self.docs[doc] for doc, _, _ in self.pieces}
        self.total = sum(p[2] for p in self.pieces)

    def end(self) -> None:
        self._close()
        for part in powers(self.pieces, self.capacity):
            self._emit(part)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in PIECE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(names))], names=names)


def pack_documents(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", tokenizer_path: str | None = None,
    capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS, cut: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty (one id, the end id), null ids pass through. Repeated rows are packed each for
    itself. An empty table gives no piece. Other columns are ignored. No shuffle: each task packs the rows it
    reads, with one open group in memory, so a retried task makes the same pieces. Without ``cut`` documents
    shorter than the capacity stay whole, and windows keep the room that differencing leaves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, number = encoder(vocabulary, tokenizer_path), _Packer(TaskContext.get().partitionId(), capacity, group_windows, cut), 0
        end = np.array([END_ID], np.uint32)
        for ids, texts in chunks(batches):
            for doc_id, x in zip(ids, enc.encode(texts)):
                packer.add(number, doc_id, np.concatenate([x, end]).astype("<u4"))
                number += 1
            yield packer.take()
        packer.end()
        yield packer.take()
        enc.release()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECE)
