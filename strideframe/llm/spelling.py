"""Spelling variants of the words of a corpus, by Aho-Corasick automata over the halves of words.

If one edit turns a word into another, one of its two halves stands unchanged at the start or at the end of the other.
Each word lays both halves into automaton shards; each word is sent, for the three lengths a partner can have, to the shards
that would hold a half it begins or ends with, and is scanned there. A hit counts if the half
stands at its place (offset) and the lengths differ by one at most; then the distance is verified.

A half that very many words share would make one shard's pairs grow with its square. Its words are cut again: the part that
still may differ is halved, and partners must share one of these halves too. That goes on until no
place is crowded or a single character is left, whose variants are as many as there are letters.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import ne

import ahocorasick
import numpy as np
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, trim
from .lexical_search import LOWER, UPPER, pieces

LEAST_LENGTH, LEAST_COUNT, DROP_EVERY, FORM_TIMES = 7, 2, 31, 10
#: Rows of a shard, and rows that may meet at one place of it before it is cut again.
SHARD_ROWS, CROWD = 100_000, 2_000
#: Words a task counts before it gives them out, and cells compared at a time.
HELD_WORDS, CELLS = 400_000, 4_000_000

_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_RUN = re.compile("[a-zÀ-ÿ]+")
PLACE = ["length", "low", "high"]
PAIRS = "word string, near string, near_n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
            found: Counter = Counter()
            for piece in pieces(text.as_py()):
                found.update(_RUN.findall(piece.translate(_LOWERED).decode()))
            begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in found.items():
                if len(run) < LEAST_LENGTH:
                    continue
                h = zlib.crc32(run.encode(), begun)
                if h % DROP_EVERY == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_LENGTH:
                        continue
                total[run] += n
            if len(total) > HELD_WORDS:
                yield out()
                total.clear()
    if total:
        yield out()
    trim()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough. Counts are summed within the tasks first."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def intact() -> Column:
    """What stands outside the part that may differ: [low, high) in a word of ``length``, shifted at its end in the scanned word."""
    end = F.col("high") + F.length("word") - F.col("length")
    return F.concat(F.substring("word", F.lit(1), F.col("low")), F.lit("\0"), F.substring("word", end + 1, F.length("word")))


def halved(rows: DataFrame) -> DataFrame:
    """Each row (word, n, holds, length, low, high) twice: with the left and with the right half of [low, high) as intact."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    part = F.explode(F.array(F.struct(middle.alias("low"), F.col("high").alias("high")), F.struct(F.col("low").alias("low"), middle.alias("high"))))
    cut = rows.select("word", "n", "holds", "length", part.alias("part")).select("word", "n", "holds", "length", "part.low", "part.high")
    return cut.filter(F.col("high") + F.length("word") - F.col("length") >= F.col("low"))


def placed(words: DataFrame, crowd: int) -> DataFrame:
    """Rows by the place at which they meet; crowded places are cut until they are not."""
    size = F.length("word")
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("holds"), (size + d).alias("length")) for h, d in ((True, 0), (False, -1), (False, 0), (False, 1))]))
    rows = words.select("word", "n", each.alias("e")).select("word", "n", "e.holds", "e.length", F.lit(0).alias("low"), F.col("e.length").alias("high"))
    rows, ready = halved(rows), None
    while True:
        keyed = staged(rows.withColumn("intact", intact()), "places")
        full = keyed.groupBy(*PLACE, "intact").count().filter((F.col("count") > crowd) & (F.col("high") - F.col("low") >= 2)).drop("count")
        full = staged(full.withColumn("full", F.lit(True)), "crowded-places")
        if full.isEmpty():
            return keyed if ready is None else ready.union(keyed)
        met = staged(keyed.join(full, [*PLACE, "intact"], "left"), "places-met")
        discard(keyed, full)
        calm = met.filter("full is null").select(keyed.columns)
        ready, rows = calm if ready is None else ready.union(calm), halved(met.filter("full"))


def one_edit(a: str, b: str) -> bool:
    """Whether different texts differ by one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :]


def _codes(parts: list[str]) -> np.ndarray:
    return np.array([list(map(ord, p)) for p in parts], np.uint32).reshape(len(parts), -1)


def one_edit_pairs(held: list[str], scanned: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(held, scanned) numbers of the texts that differ by one edit; all of a side are of one length, the two differ by one at most."""
    a, b = _codes(held), _codes(scanned)
    n, m = a.shape[1], b.shape[1]
    found = [[], []]
    step = max(1, CELLS // max(1, len(b) * max(n, m)))
    for lo in range(0, len(a), step):
        x, y = a[lo : lo + step, None, :], b[None]
        if n == m:
            good = (x != y).sum(axis=2) == 1
        else:
            short, long = (x, y) if n < m else (y, x)
            k = min(n, m)
            head = np.logical_and.accumulate(short == long[:, :, :k], axis=2).sum(axis=2)
            tail = np.logical_and.accumulate((short == long[:, :, 1:])[:, :, ::-1], axis=2).sum(axis=2)
            good = head + tail >= k
        i, j = np.nonzero(good)
        found[0].append(i + lo)
        found[1].append(j)
    return np.concatenate(found[0]), np.concatenate(found[1])


def _scan(table: pa.Table) -> pa.Table:
    rows = table.to_pydict()
    holders: dict[tuple, list] = {}
    words: dict[str, int] = {}
    for word, n, holds, *place in zip(*(rows[c] for c in ("word", "n", "holds", *PLACE))):
        if holds:
            _, low, high = place
            holders.setdefault((*place, word[:low], word[high:]), []).append((word, n))
        else:
            words[word] = n
    automaton, halves = ahocorasick.Automaton(), {}
    for place in holders:
        *_, before, after = place
        at_start = len(before) >= len(after)
        halves.setdefault(before if at_start else after, []).append((at_start, place))
    for half, places in halves.items():
        automaton.add_word(half, (len(half), places))
    out: list[list] = [[], [], []]
    scanned: dict[tuple, list] = {}
    if halves:
        automaton.make_automaton()
        for word, n in words.items():
            size = len(word)
            for end, (length, places) in automaton.iter(word):
                starts, ends = end == length - 1, end == size - 1
                if starts or ends:
                    for at_start, place in places:
                        shift = size - place[0]
                        if (starts if at_start else ends) and -1 <= shift <= 1 and place[2] + shift >= place[1] and word.startswith(place[3]) and word.endswith(place[4]):
                            scanned.setdefault((place, shift), []).append((word, n))
    for (place, shift), mine in scanned.items():
        _, low, high, *_ = place
        held = holders[place]
        if len(held) * len(mine) <= 64:
            near = [(h, s) for h in held for s in mine if h[0] != s[0] and one_edit(h[0][low:high], s[0][low : high + shift])]
        else:
            near = [(held[i], mine[j]) for i, j in zip(*one_edit_pairs([h[0][low:high] for h in held], [s[0][low : high + shift] for s in mine]))]
        out[0] += [s[0] for _, s in near]
        out[1] += [h[0] for h, _ in near]
        out[2] += [h[1] for h, _ in near]
    return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])


def near_words(words: DataFrame, shard_rows: int = SHARD_ROWS, crowd: int = CROWD) -> DataFrame:
    """word, near, near_n: every ordered pair of ``words`` (word, n) that differ by one edit; a pair may come more than once."""
    rows = placed(words, crowd)
    shards = max(1, -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64(*PLACE, "intact"), F.lit(shards).cast("long"))
    return rows.withColumn("shard", shard).drop("intact").groupBy("shard").applyInArrow(_scan, PAIRS)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form. Each round follows twice as many forms; a form is FORM_TIMES as frequent
    as its word, so chains are short."""
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(at.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        if moved.filter("moved").isEmpty():
            return moved.select("word", "root")
        at = staged(moved.select("word", "root"), "roots")
        discard(moved)


def spelling_variants(docs: DataFrame, shard_rows: int = SHARD_ROWS, crowd: int = CROWD) -> DataFrame:
    """One row per word: word, form, root (string), n, n_near, form_n (long).

    A word is near another if one code point is inserted, deleted or replaced. Its form is the most frequent near word (ties: the
    smallest) if that is FORM_TIMES as frequent, its root the last of the forms that follow. Null and empty texts have no
    words; a null doc_id counts as an empty one where a run is hashed; repeated rows count each. Empty tables give an empty
    result; other columns are ignored. ``shard_rows`` and ``crowd`` change the work only. Runs Spark jobs when called.
    """
    words = staged(vocabulary(docs), "vocabulary")
    # the words near one word are bounded by its length and the letters
    each = near_words(words, shard_rows, crowd).groupBy("word").agg(F.collect_set(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("all"))
    best = F.array_min("all")
    near = staged(each.select("word", F.size("all").cast("long").alias("n_near"), best["near"].alias("form"), (-best["less"]).alias("form_n")), "near-words")
    known = staged(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(F.col("form_n") >= FORM_TIMES * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")],
    ), "forms")
    discard(words, near)
    roots = _roots(known.filter("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
