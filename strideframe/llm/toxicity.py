"""Toxicity with a counterfactually regularised classifier.

A logistic model over the presence of words and of word beginnings (``stem*``), counted by Spark over a
bounded sample of labelled rows. For every training text copies are made that say the same of somebody else:
where it names a group, the name is swapped for another of its kind and for a neutral noun; where it names
none, a name is put in. The squared change of the score between a text and its copies is penalised, so
naming a group tells nothing.

How sure a feature must be (its chi-square with the label) and how strongly weights are drawn to zero are
chosen by the ranking of a fold inside the training rows; the held-out fold plays no part in it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, staged, trim

#: About so many labelled rows are learned from, chosen by a hash of their ids.
MAX_TRAIN = 20_000
#: Settings that the inner fold chooses from: least chi-square of a feature, pull of weights to zero.
SETTINGS = [(floor, l2) for floor in (15.0, 8.0, 4.0) for l2 in (1e-4, 1e-3)]
COUNTERFACTUAL, STEPS, TRIAL_STEPS = 1.0, 400, 150
#: Lengths of the word beginnings that count beside the word itself.
STEM_CHARS = range(5, 9)
#: Words whose features a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 200_000
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")

# Group names that may be swapped for each other, by language and kind.
IDENTITY = {
    "en": [
        "muslim christian jewish hindu buddhist catholic atheist", "muslims christians jews hindus buddhists catholics atheists",
        "gay lesbian bisexual straight transgender queer", "black white asian latino african european", "woman man girl boy", "women men girls boys",
        "immigrant refugee foreigner", "immigrants refugees foreigners", "mexican american chinese german french spanish indian arab turkish polish", "disabled blind deaf autistic",
    ],
    "de": ["muslime christen juden hindus buddhisten", "schwule lesben", "frau mann", "frauen männer", "ausländer flüchtlinge einwanderer", "türken polen deutsche franzosen araber", "behinderte blinde gehörlose"],
    "fr": ["musulmans chrétiens juifs hindous bouddhistes", "homosexuels lesbiennes", "femme homme", "femmes hommes", "étrangers réfugiés immigrés", "arabes allemands français espagnols", "handicapés aveugles sourds"],
    "es": ["musulmanes cristianos judíos hindúes budistas", "homosexuales lesbianas", "mujer hombre", "mujeres hombres", "extranjeros refugiados inmigrantes", "árabes alemanes franceses españoles", "discapacitados ciegos sordos"],
}
NEUTRAL = {"en": "person", "de": "mensch", "fr": "personne", "es": "persona"}
Terms = dict[str, list[str]]


class Names:
    """Group names: the others of each one's kind, and the neutral noun of its language."""

    def __init__(self, identity: Terms, neutral: dict[str, str]) -> None:
        self.others: dict[str, list[str]] = {}
        self.noun: dict[str, str] = {}
        for lang, kinds in identity.items():
            for kind in kinds:
                for term in kind.split():
                    self.others.setdefault(term, [x for x in kind.split() if x != term])
                    self.noun.setdefault(term, neutral[lang])
        self.every = sorted(self.others)


NAMES = Names(IDENTITY, NEUTRAL)


def words_in(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEM_CHARS if len(word) > k)]


def features_in(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


def counterfactuals(words: set[str], names: Names = NAMES) -> list[set[str]]:
    """Copies of a text's words: its group names swapped for others of their kinds and for neutral nouns, or, if it
    has none, a name put in."""
    named = sorted(w for w in words if w in names.others)
    pick = zlib.crc32(" ".join(sorted(words)[:20]).encode())
    if not named:
        return [words | {names.every[pick % len(names.every)]}] if names.every else []
    rest = words.difference(named)
    swapped = {names.others[w][(pick + i) % len(names.others[w])] for i, w in enumerate(named)}
    return [rest | swapped, rest | {names.noun[w] for w in named}]


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            words, labels, inner = [], [], []
            for text, y, i in zip(*(part.column(c).to_pylist() for c in ("text", "toxic", "inner"))):
                found = features_in(words_in(text))
                words += found
                labels += [y] * len(found)
                inner += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32()), pa.array(inner, pa.bool_())], names=["word", "toxic", "inner"])
    trim()


def _feature_rows(index: dict[str, int], names: Names):
    def numbers(words: set[str]) -> list[int]:
        return sorted(index[f] for f in features_in(words) if f in index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [words_in(text) for text in part.column("text").to_pylist()]
                xs, swaps = [numbers(w) for w in found], [[numbers(c) for c in counterfactuals(w, names)] for w in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(xs, pa.list_(pa.int32())), part.column("toxic"), part.column("inner"), pa.array(swaps, pa.list_(pa.list_(pa.int32())))], names=["x", "y", "inner", "swaps"]
                )
        trim()

    return run


class _Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)
        self.n = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) if len(self.col) else np.zeros(self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], width) if len(self.col) else np.zeros(width)


def train(
    xs: list[list[int]], ys: list[int], pairs: list[tuple[int, list[int]]], width: int, penalty: float = COUNTERFACTUAL, steps: int = STEPS,
    l2: float = 1e-4, active: np.ndarray | None = None,
) -> tuple[np.ndarray, float]:
    """(weights, bias) by full-batch Adam. ``pairs``: a row's number and the features of a copy of it. Features that
    are not ``active`` keep weight 0."""
    rows, y = _Rows(xs), np.array(ys, float)
    original, copies = _Rows([xs[i] for i, _ in pairs]), _Rows([c for _, c in pairs])
    live = np.ones(width) if active is None else active.astype(float)
    w, rate = np.zeros(width), np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    b = float(np.log(rate / (1 - rate)))
    m, s, mb, sb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(rows.dot(w) + b)))
        g = (p - y) / max(1, rows.n)
        gw, gb = rows.back(g, width) + l2 * w, float(g.sum())
        if pairs:
            change = (original.dot(w) - copies.dot(w)) * (2 * penalty / len(pairs))
            gw += original.back(change, width) - copies.back(change, width)
        gw *= live
        m, s = 0.9 * m + 0.1 * gw, 0.99 * s + 0.01 * gw * gw
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        lr = 0.1 * (1 - 0.9 * step / steps)
        w -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
        b -= lr * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.99**step)) + 1e-9)
    return w, b


def ranking(scores: np.ndarray, labels: np.ndarray) -> float:
    """The share of pairs of a toxic and another row that the scores put in the right order; ties count half."""
    _, at, n = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    pos = labels == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def _chi2(n: int, t: int, c, k):
    """Chi-square of a feature with the label; 0 where it speaks against toxicity."""
    gap = k * (n - t) - (c - k) * t
    return F.when(gap > 0, n * gap * gap / (c * (n - c + 1e-9) * float(t) * float(n - t))).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, penalty: float = COUNTERFACTUAL, names: Names = NAMES, max_train: int = MAX_TRAIN) -> tuple[dict[str, float], float]:
    """(weights, bias), from about ``max_train`` of the labelled rows outside the held-out fold. Everything that is
    collected is bounded by that sample."""
    learn = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2))
    learn = learn.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, max_train / max(1, learn.count()))
    chosen = learn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0 < share).limit(2 * max_train)
    chosen = chosen.withColumn("inner", crc_mod("doc_id", 4) != 3)  # the rest of the training rows judges the settings
    sample = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "inner"), "toxicity-sample")
    size = {r["inner"]: (r["n"], r["t"]) for r in sample.groupBy("inner").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    n_in, t_in = size.get(True, (0, 0))
    n, t = n_in + size.get(False, (0, 0))[0], t_in + size.get(False, (0, 0))[1]
    if not t or t == n:
        discard(sample)
        return {}, float(np.log((t + 0.5) / (n - t + 0.5)))
    trial = 0 < t_in < n_in and 0 < t - t_in < n - n_in
    inner = F.when(F.col("inner"), 1).otherwise(0)
    counts = sample.mapInArrow(_word_rows, "word string, toxic int, inner boolean").groupBy("word").agg(
        F.count("*").cast("double").alias("c"), F.sum("toxic").cast("double").alias("k"), F.sum(inner).cast("double").alias("c_in"), F.sum(inner * F.col("toxic")).cast("double").alias("k_in")
    )
    chi2, chi2_in = _chi2(n, t, F.col("c"), F.col("k")), _chi2(n_in, t_in, F.col("c_in"), F.col("k_in")) if trial else F.lit(0.0)
    least = min(floor for floor, _ in SETTINGS)
    found = counts.filter("k > 1").select("word", chi2.alias("chi2"), chi2_in.alias("chi2_in")).filter(F.greatest("chi2", "chi2_in") >= least)
    of = {r["word"]: (r["chi2"], r["chi2_in"]) for r in found.collect()}
    of |= {f: (np.inf, np.inf) for f in features_in(set(names.every)) if f not in of}  # names of groups always count
    words = sorted(of)
    strength = np.array([of[w] for w in words])
    rows = sample.mapInArrow(_feature_rows({w: i for i, w in enumerate(words)}, names), "x array<int>, y int, inner boolean, swaps array<array<int>>").collect()
    discard(sample)
    rows.sort(key=lambda r: (r["x"], r["y"], r["inner"]))

    def trained(some: list, active: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
        pairs = [(i, c) for i, r in enumerate(some) for c in r["swaps"] if c != r["x"]]
        return train([r["x"] for r in some], [r["y"] for r in some], pairs, len(words), penalty, steps, l2, active)

    best = SETTINGS[0]
    if trial:
        known, judge = [r for r in rows if r["inner"]], [r for r in rows if not r["inner"]]
        asked, labels_in = _Rows([r["x"] for r in judge]), np.array([r["y"] for r in judge])
        results = [ranking(asked.dot(trained(known, strength[:, 1] >= floor, l2, TRIAL_STEPS)[0]), labels_in) for floor, l2 in SETTINGS]
        best = SETTINGS[int(np.argmax(np.round(results, 4)))]
    w, b = trained(rows, strength[:, 0] >= best[0], best[1], STEPS)
    return {x: float(v) for x, v in zip(words, w) if v}, float(b)


class Scorer:
    """Scores texts by the features of a model; remembers which of them each word has."""

    def __init__(self, model: tuple[dict[str, float], float]) -> None:
        self.weights, self.bias = model
        self.known: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        found: set[str] = set()
        for w in words_in(text):
            if (has := self.known.get(w)) is None:
                has = self.known[w] = tuple(f for f in features_of(w) if f in self.weights)
            if has:
                found.update(has)
        total = self.bias + sum(sorted(self.weights[f] for f in found))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def score_toxicity(docs: DataFrame, labels: DataFrame, model: tuple[dict[str, float], float] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts score as a text without any known word. Without labels of both kinds the score
    is the smoothed base rate. Repeated rows repeat their result, a null id is not held out, an empty
    table gives an empty one, other columns are ignored. The score reads the text alone. The model is
    learned, in Spark jobs, when the operator is called.
    """
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(x) for lo in range(0, batch.num_rows, 256) for x in batch.column("text").slice(lo, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(x >= THRESHOLD) for x in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )
        trim()

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text"
    ).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
