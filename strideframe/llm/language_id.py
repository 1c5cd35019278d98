"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained with numpy by backpropagation through time on a bounded sample. It labels every
byte position of the whole text; a document's probabilities are the mean over its positions. Texts are
read in windows of WINDOW bytes, each from both ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, trim

HIDDEN = 8
WINDOW = 128
BATCH = 2048
#: Bounds of the training sample: documents of each language, windows of each document.
DOCS_A_LANGUAGE, WINDOWS_A_DOC = 500, 4
STEPS, RATE, TRAIN_BATCH, TRAIN_WINDOW = 350, 0.02, 256, 64
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"
#: A document is rejected when it is undetermined or its language's probability is lower.
MIN_SCORE = 0.3

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def start_params(n_labels: int, hidden: int = HIDDEN, seed: int = 7) -> Params:
    r = np.random.default_rng(seed)
    return {
        "x": r.normal(0, 0.3, (2, 3 * hidden, 256)).astype(np.float32),
        "u": r.normal(0, 0.3, (2, 3 * hidden, hidden)).astype(np.float32),
        "v": r.normal(0, 0.3, (n_labels, 2 * hidden)).astype(np.float32),
        "b": np.zeros((n_labels, 1), np.float32),
    }


def loss_and_gradients(p: Params, windows: np.ndarray, labels: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy over the positions of (batch, time) windows; byte 0 pads and is not scored."""
    n, t_len = windows.shape
    h_size = p["u"].shape[2]
    both = np.stack([windows, windows[:, ::-1]])  # direction, batch, time
    h = np.zeros((2, h_size, n), np.float32)
    kept = []
    states = np.zeros((t_len, 2, h_size, n), np.float32)
    for t in range(t_len):
        x = np.stack([p["x"][d][:, both[d, :, t]] for d in (0, 1)])
        g = p["u"] @ h
        rz = _sigmoid(x[:, : 2 * h_size] + g[:, : 2 * h_size])
        r, z = rz[:, :h_size], rz[:, h_size:]
        c = np.tanh(x[:, 2 * h_size :] + r * g[:, 2 * h_size :])
        kept.append((h, r, z, c, g[:, 2 * h_size :]))
        h = c + z * (h - c)
        states[t] = h
    joint = np.concatenate([states[:, 0], states[::-1, 1]], axis=1)  # time, 2h, batch
    logits = p["v"] @ joint + p["b"]
    logits -= logits.max(axis=1, keepdims=True)
    probs = np.exp(logits)
    probs /= probs.sum(axis=1, keepdims=True)
    live = (windows != 0).T
    total = max(1, int(live.sum()))
    right = probs[np.arange(t_len)[:, None], labels[None, :], np.arange(n)[None, :]]
    loss = float(-(np.log(right + 1e-9) * live).sum() / total)
    d_logits = probs
    d_logits[np.arange(t_len)[:, None], labels[None, :], np.arange(n)[None, :]] -= 1
    d_logits *= live[:, None, :] / np.float32(total)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["v"] = np.einsum("tln,thn->lh", d_logits, joint, optimize=True)
    grads["b"] = d_logits.sum(axis=(0, 2))[:, None]
    d_joint = p["v"].T @ d_logits
    d_states = np.stack([d_joint[:, :h_size], d_joint[::-1, h_size:]], axis=1)
    dh = np.zeros((2, h_size, n), np.float32)
    for t in range(t_len - 1, -1, -1):
        before, r, z, c, gn = kept[t]
        dh = dh + d_states[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (before - c) * z * (1 - z)
        dr = dc * gn * r * (1 - r)
        dg = np.concatenate([dr, dz, dc * r], axis=1)
        dx = np.concatenate([dr, dz, dc], axis=1)
        grads["u"] += dg @ before.transpose(0, 2, 1)
        for d in (0, 1):
            one_hot = np.zeros((n, 256), np.float32)
            one_hot[np.arange(n), both[d, :, t]] = 1
            grads["x"][d] += dx[d] @ one_hot
        dh = dh * z + p["u"].transpose(0, 2, 1) @ dg
    return loss, grads


def train(windows: np.ndarray, labels: np.ndarray, n_labels: int, steps: int = STEPS, seed: int = 7) -> Params:
    """Adam on random batches with equal weight for every label; windows are cut at random to TRAIN_WINDOW."""
    r = np.random.default_rng(seed)
    p = start_params(n_labels, seed=seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    by_label = [np.flatnonzero(labels == i) for i in range(n_labels)]
    by_label = [x for x in by_label if len(x)]
    width = min(TRAIN_WINDOW, windows.shape[1])
    for step in range(1, steps + 1):
        pick = np.array([r.choice(by_label[i]) for i in r.integers(0, len(by_label), TRAIN_BATCH)])
        at = r.integers(0, windows.shape[1] - width + 1)
        _, g = loss_and_gradients(p, windows[pick, at : at + width], labels[pick])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = RATE * (1 - 0.9 * step / steps)
        for k in p:
            grad = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * grad
            s[k] = 0.999 * s[k] + 0.001 * grad * grad
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def label_positions(p: Params, windows: np.ndarray) -> np.ndarray:
    """Sums over each window's positions of the label probabilities: (windows, labels)."""
    n, t_len = windows.shape
    h_size = p["u"].shape[2]
    half, h2 = np.float32(0.5), 2 * h_size
    # gates by tanh: a logistic gate is half a tanh of half its input, plus a half
    x, u = p["x"].copy(), p["u"].copy()
    x[:, :h2] *= half
    u[:, :h2] *= half
    columns = [np.ascontiguousarray(windows[:, t]) for t in range(t_len)]
    states = np.empty((t_len, h2, n), np.float32)
    a, g, rz = np.empty((3 * h_size, n), np.float32), np.empty((3 * h_size, n), np.float32), np.empty((h2, n), np.float32)
    c = np.empty((h_size, n), np.float32)
    for d in (0, 1):
        xd, ud = np.ascontiguousarray(x[d]), u[d]
        h = np.zeros((h_size, n), np.float32)
        for t in range(t_len) if d == 0 else range(t_len - 1, -1, -1):
            np.take(xd, columns[t], axis=1, out=a, mode="clip")
            np.matmul(ud, h, out=g)
            np.add(a[:h2], g[:h2], out=rz)
            np.tanh(rz, out=rz)
            rz *= half
            rz += half
            np.multiply(rz[:h_size], g[h2:], out=c)
            c += a[h2:]
            np.tanh(c, out=c)
            h -= c
            h *= rz[h_size:]
            h += c
            states[t, d * h_size : (d + 1) * h_size] = h
    out = np.zeros((p["v"].shape[0], n), np.float32)
    for t in range(t_len):
        logits = p["v"] @ states[t] + p["b"]
        logits -= logits.max(axis=0)
        np.exp(logits, out=logits)
        logits *= (columns[t] != 0) / logits.sum(axis=0)
        out += logits
    return out.T


def document_probabilities(p: Params, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities of each text over all of its bytes; zeros for an empty text."""
    sizes = np.array([len(x) for x in texts], np.int64)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    sums = np.zeros((len(texts), p["v"].shape[0]))
    scored = np.zeros(len(texts))
    joined = b"".join(x + b"\0" * (-len(x) % WINDOW) for x in texts)
    windows = np.frombuffer(joined, np.uint8).reshape(-1, WINDOW)
    for i in range(0, len(windows), BATCH):
        part = windows[i : i + BATCH]
        np.add.at(sums, owner[i : i + BATCH], label_positions(p, part))
        np.add.at(scored, owner[i : i + BATCH], (part != 0).sum(axis=1))
    return sums / np.maximum(scored, 1)[:, None]


def training_windows(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A sample of windows of labelled documents outside the held-out fold: every language, a bounded number of each."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 5) != 0)).select(
        "doc_id", "text", "lang", F.xxhash64("doc_id").alias("h")
    )
    counts = known.groupBy("lang").count()
    languages = sorted(r["lang"] for r in counts.collect())
    if not languages:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    shares = counts.select("lang", F.least(F.lit(1.0), DOCS_A_LANGUAGE / F.col("count")).alias("share"))
    chosen = known.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1_000_003)) / 1_000_003.0 < F.col("share"))
    at = F.pmod(F.xxhash64("doc_id", "k"), F.greatest(F.char_length("text") - WINDOW, F.lit(1))).cast("int") + 1
    place = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id", "k", "piece"))
    rows = (
        chosen.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(WINDOWS_A_DOC)])))
        .select("lang", "doc_id", "k", F.substring(F.col("text"), at, F.lit(WINDOW)).alias("piece"))
        .withColumn("place", place).filter(F.col("place") <= 2 * DOCS_A_LANGUAGE * WINDOWS_A_DOC)
        .orderBy("doc_id", "k", "piece").collect()
    )
    rows = [r for r in rows if LETTER.search(r["piece"])]
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for i, r in enumerate(rows):
        raw = r["piece"].encode()[:WINDOW]
        windows[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    index = {x: i for i, x in enumerate(languages)}
    return windows, np.array([index[r["lang"]] for r in rows], np.int64), languages


def fit(docs: DataFrame) -> tuple[Params, list[str]]:
    windows, labels, languages = training_windows(docs)
    return (train(windows, labels, len(languages)) if len(windows) else start_params(max(1, len(languages)))), languages


def _predict(p: Params, languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column("text").to_pylist()
                has_letter = [t is not None and LETTER.search(t) is not None for t in texts]
                probs = document_probabilities(p, [t.encode() if ok else b"" for t, ok in zip(texts, has_letter)])
                best = probs.argmax(axis=1)
                decided = [ok and bool(languages) for ok in has_letter]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("held_out"),
                    pa.array([languages[b] if ok else UNDETERMINED for b, ok in zip(best, decided)], pa.string()),
                    pa.array([float(min(1.0, probs[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, decided))], pa.float64()),
                ], names=["doc_id", "held_out", "lang_pred", "score"])
        trim()

    return run


def identify_languages(docs: DataFrame, model: tuple[Params, list[str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0. Without any labelled document all
    are ``und``. Repeated rows repeat their result, a null id is not held out, an empty table gives an
    empty one, other columns are ignored. The prediction reads the text alone. The network is trained, on
    a sample that Spark gathers, when the operator is called.
    """
    params, languages = model or fit(docs)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text"
    ).mapInArrow(_predict(params, languages), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is determined with a probability of ``min_score``, with all their columns;
    no shuffle. Null texts and texts without a letter go; repeated rows and null ids are judged each by itself."""
    params, languages = fit(docs)
    predict = _predict(params, languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            slim = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.zeros(n, bool)), batch.column(batch.schema.get_field_index("text"))], names=["doc_id", "held_out", "text"])
            keep = []
            for got in predict(iter([slim])):
                keep += [lang != UNDETERMINED and score >= min_score for lang, score in zip(got.column(2).to_pylist(), got.column(3).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
