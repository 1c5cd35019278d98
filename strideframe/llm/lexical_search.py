"""Ranked lexical search over an inverted index in shards, by MaxScore within each shard.

A shard holds the postings of up to SHARD_DOCS documents that stand together: a row for each term with the places
of its documents and its counts there. Terms that no query holds are left out by a bitmap of fixed size. Queries
come in blocks of bounded size; a task gets one shard and one block, that is the lists of the terms of the
block. It orders a query's terms by the most each can add to a score in the shard. Once ten documents are known, terms whose
bounds together stay below the tenth score are non-essential: a document found in their lists alone cannot
qualify. Only the essential lists are read through; the others are probed, largest bound first, for the
documents that could still qualify. The score to beat rises from window to window of documents.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged, trim

#: Postings hold a document's place in its shard in 16 bits.
SHARD_DOCS, SHARD_BYTES = 1 << 14, 128_000_000
WINDOW_DOCS = 2048
ITEMS_A_BLOCK = 256
#: Bits of the bitmap of query terms: half a megabyte whatever the tables hold.
BITMAP_BITS = 1 << 22
#: Long texts are cut into terms piece by piece.
PIECE_BYTES = 4_000_000
BEST = 10

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")

INDEX = "shard long, term string, n_docs long, n_terms long, places binary, counts binary, ids array<long>"
FOUND = "item_no long, doc_id long, score long"


def pieces(text: bytes, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``most`` bytes, cut where no term goes on."""
    at = 0
    while len(text) - at > most:
        found = _BREAK.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def counted(text: bytes) -> Counter:
    """The terms of a text, how often each occurs."""
    found: Counter = Counter()
    for piece in pieces(text):
        found.update(_TERM.findall(piece.translate(_LOWERED)))
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """item_no, term, asked: the terms of each item with their repeats."""
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), SEPARATORS), "")
    return items.select("item_no", F.explode(words).alias("term")).groupBy("item_no", "term").agg(F.count("*").alias("asked"))


def bitmap_of(terms: DataFrame, bits: int = BITMAP_BITS) -> bytes:
    """A bit for the hash of each term."""
    at = F.crc32(F.col("term").cast("binary")) % bits
    found = terms.select(F.bitmap_bucket_number(at + 1).alias("bucket"), F.bitmap_bit_position(at + 1).alias("bit"))
    rows = found.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()  # bits / 32768 rows at most
    out = bytearray(bits // 8)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return bytes(out)


def _emit(shard: int, lists: dict, ids: list, sizes: list) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in INDEX.split(", ")]
    n = np.array(sizes, np.int64)
    info = [[shard], [None], [int((n > 0).sum())], [int(n.sum())], [None], [n.tobytes()], [ids]]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(info, kinds)], names=names)
    terms = sorted(lists)
    for lo in range(0, len(terms), 1000):
        part = terms[lo : lo + 1000]
        held = [lists[t] for t in part]
        cols = [[shard] * len(part), [t.decode() for t in part], [len(p) for p, _ in held], [None] * len(part), [p.tobytes() for p, _ in held], [c.tobytes() for _, c in held], [None] * len(part)]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names=names)


def _postings(bitmap: bytes, bits: int, shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        lists, ids, sizes, held = {}, [], [], 0
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                text = text.as_py()
                if len(ids) >= shard_docs or held and held + len(text) > SHARD_BYTES:
                    yield from _emit(shard, lists, ids, sizes)
                    shard, lists, ids, sizes, held = shard + 1, {}, [], [], 0
                found = counted(text)
                for term, count in found.items():
                    mine = lists.get(term)
                    if mine is None:
                        h = zlib.crc32(term) % bits
                        if not bitmap[h >> 3] >> (h & 7) & 1:
                            continue
                        mine = lists[term] = (array("H"), array("I"))
                    mine[0].append(len(ids))
                    mine[1].append(min(count, 2**32 - 1))
                ids.append(doc_id)
                sizes.append(sum(found.values()))
                held += len(text)
        if ids:
            yield from _emit(shard, lists, ids, sizes)
        trim()

    return run


def build_index(docs: DataFrame, terms: DataFrame, bits: int = BITMAP_BITS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of every row of ``docs`` for ``terms``: a row for each shard and term (n_docs, places, counts), and one
    for each shard without a term (n_docs and n_terms of its documents, their ids and sizes). Null texts have no terms."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return staged(texts.mapInArrow(_postings(bitmap_of(terms, bits), bits, min(shard_docs, SHARD_DOCS)), INDEX), "postings")


class Postings:
    """A term's list in one shard: places, what each document adds for one occurrence in a query, the most of it, and
    where each window of documents begins."""

    def __init__(self, weight: int, places: np.ndarray, counts: np.ndarray, m: np.ndarray, edges: np.ndarray):
        self.places, tf = places, counts.astype(np.int64)
        self.adds = weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[places]))
        self.most = int(self.adds.max())
        self.cuts = np.searchsorted(places, edges)


def max_score(asked: list[tuple[int, Postings]], edges: np.ndarray, k: int = BEST) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the documents of a shard that can be among the ``k`` best: all with scores above 0 that reach the
    k-th of them, in no order."""
    asked = sorted(asked, key=lambda x: x[0] * x[1].most)
    below = np.concatenate([[0], np.cumsum([n * p.most for n, p in asked])])  # the most that the first lists add together
    places, scores, beat = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    for w in range(len(edges) - 1):
        first = int(np.searchsorted(below[1:], beat))  # lists before it are non-essential
        if first == len(asked):
            break
        lo = int(edges[w])
        total = np.zeros(int(edges[w + 1]) - lo, np.int64)
        for n, p in asked[first:]:
            part = slice(p.cuts[w], p.cuts[w + 1])
            total[p.places[part] - lo] += n * p.adds[part]
        open_docs = np.flatnonzero((total > 0) & (total + below[first] >= beat)) if first else np.flatnonzero(total >= beat)
        for j in range(first - 1, -1, -1):
            if not len(open_docs):
                break
            n, p = asked[j]
            part = slice(p.cuts[w], p.cuts[w + 1])
            held = p.places[part] - lo
            at = np.searchsorted(held, open_docs)
            hit = at < len(held)
            hit[hit] = held[at[hit]] == open_docs[hit]
            total[open_docs[hit]] += n * p.adds[part][at[hit]]
            open_docs = open_docs[total[open_docs] + below[j] >= beat]
        if len(open_docs):
            places = np.concatenate([places, open_docs + lo])
            scores = np.concatenate([scores, total[open_docs]])
            if len(scores) >= k:
                beat = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= beat
                places, scores = places[keep], scores[keep]
    return places, scores


def _search(n_docs: int, n_terms: int, k: int, window: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        info = rows["term"].index(None)
        ids = rows["ids"][info]
        nulls = np.array([x is None for x in ids], bool)
        doc_id = np.array([0 if x is None else x for x in ids], np.int64)
        m = 25 + (75 * np.frombuffer(rows["counts"][info], np.int64) * n_docs) // max(n_terms, 1)
        edges = np.append(np.arange(0, len(ids), window), len(ids))
        queries: dict[int, list] = {}
        for term, weight, places, counts, asks in zip(*(rows[c] for c in ("term", "weight", "places", "counts", "asks"))):
            if term is not None:
                held = Postings(weight, np.frombuffer(places, np.uint16).astype(np.int64), np.frombuffer(counts, np.uint32), m, edges)
                for ask in asks:
                    queries.setdefault(ask["item_no"], []).append((ask["asked"], held))
        out: list[list] = [[], [], []]
        for item, asked in queries.items():
            places, scores = max_score(asked, edges, k)
            best = np.lexsort((doc_id[places], nulls[places], -scores))[:k]
            out[0] += [item] * len(best)
            out[1] += [None if nulls[p] else int(doc_id[p]) for p in places[best]]
            out[2] += scores[best].tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["item_no", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = BEST, bits: int = BITMAP_BITS, shard_docs: int = SHARD_DOCS, window: int = WINDOW_DOCS, items_a_block: int = ITEMS_A_BLOCK) -> DataFrame:
    """The ``k`` best rows of ``docs`` for each row of ``items``: item_id, rank, doc_id, score.

    Scores are whole numbers above 0; equal scores stand by ascending doc_id, null last. Each row of ``docs`` is a document
    and each row of ``items`` a query of its own, ids may be missing or repeated. Null and empty texts have no terms: as documents
    they are not found and do not count, as items they give no row. Empty tables give an empty result. Other columns
    are ignored. ``bits``, ``shard_docs``, ``window`` and ``items_a_block`` change the work only. Runs Spark jobs when called.
    """
    asked = items.select(items["item_id"].alias("item_id"), items["text"].alias("text"), F.monotonically_increasing_id().alias("item_no"))
    asked = staged(asked, "items")
    terms = staged(item_terms(asked), "item-terms")
    index = build_index(docs, terms, bits, shard_docs)
    lists, shards = index.filter("term is not null"), index.filter("term is null")
    total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    n_blocks = max(1, -(-asked.count() // items_a_block))
    df = lists.groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(total["n"]) + 2) / (2 * F.col("df") + 1))).cast("long")
    block = F.pmod(F.xxhash64("item_no"), F.lit(n_blocks).cast("long")).alias("block")
    wanted = terms.join(df, "term").select("term", weight.alias("weight"), block, F.struct("item_no", "asked").alias("ask"))
    wanted = staged(wanted.groupBy("block", "term", "weight").agg(F.collect_list("ask").alias("asks")), "wanted-lists")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("weight", "long"), ("asks", wanted.schema["asks"].dataType))]
    columns = ["shard", "block", "term", "weight", "places", "counts", "ids", "asks"]
    each = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).select("*", *empty).select(columns)
    met = lists.join(wanted, "term").select(columns).union(each)
    found = staged(met.groupBy("shard", "block").applyInArrow(_search(total["n"], total["terms"], k, window), FOUND), "found")
    discard(terms, index, wanted)
    order = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(asked.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
