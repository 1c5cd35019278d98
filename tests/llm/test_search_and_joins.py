"""Ranked search, spelling variants and the vector join: hard rows, small work units, plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strideframe.llm import embedding_join as vectors
from strideframe.llm import lexical_search as lexical
from strideframe.llm import spelling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = str.maketrans(lexical.UPPER, lexical.LOWER)
EXTRA = "term string, shard int, place int, score string, rank int, word string, n int, form string, rep int, dim string, low int"
LONG = " ".join(f"word{i * 7919 % 997}" for i in range(40_000))


def terms(text):
    return Counter(t.translate(UPPER) for t in TERM.findall(text or ""))


def plain_search(docs, items, k=10):
    """[(item place, [(doc_id, score)])]"""
    held = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for _, text in items:
        scores = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // max(total, 1)
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms(text).items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out.append([(i, -s) for s, _, _, i in sorted(scores)[:k]])
    return out


def plain_variants(docs):
    n = Counter()
    for i, text in docs:
        for w in RUN.findall(text or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and distance_one(v, w)] for w in words}
    form = {}
    for w, c in words.items():
        best = min(((-words[v], v) for v in near[w]), default=(0, None))
        if -best[0] >= 10 * c:
            form[w] = best[1]
    out = {}
    for w, c in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, c, len(near[w]), words[form[w]] if w in form else None)
    return out


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_links(rows, threshold=0.9):
    """[(n_links, component)] in the order of rows (vec_id, vector)."""
    unit = []
    for _, v in rows:
        v = None if v is None or not len(v) or any(x is None for x in v) else np.array(v, np.float64)
        unit.append(None if v is None or not np.isfinite(v).all() or not v.any() else v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()))
    links = [[j for j, y in enumerate(unit) if j != i and x is not None and y is not None and len(x) == len(y) and x @ y >= threshold] for i, x in enumerate(unit)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


def texts_of(spark, rows, name="doc_id"):
    return spark.createDataFrame([(i, t, *[None] * 11) for i, t in rows], f"{name} long, text string, {EXTRA}")


HARD = [
    (1, None), (2, ""), (3, " ,;"), (4, LONG), (5, LONG + " tail"), (6, "alpha Beta beta"), (6, "alpha Beta beta"), (7, "alpha Beta beta"), (None, "alpha Beta beta"),
    (None, None), (8, "ÉTÉ été 日本 x_y"), (9, "z" * 3000), (10, "alpha"), (11, "beta alpha [gamma] `delta`"),
]
ASKED = [(1, "alpha beta"), (1, "gamma Delta alpha"), (2, None), (3, ""), (None, "word5 word17 word17 tail"), (4, "été ÉTÉ 日本"), (5, "nowhere"), (6, "alpha beta")]


@pytest.mark.parametrize("shard_docs, window, block", [(3, 2, 2), (1 << 14, 2048, 256)])
def test_search_of_hard_rows(spark, shard_docs, window, block):
    got = lexical.search(texts_of(spark, HARD), texts_of(spark, ASKED, "item_id"), 4, shard_docs=shard_docs, window=window, items_a_block=block).collect()
    want = plain_search(HARD, ASKED, 4)
    mine = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=repr)
    assert mine == sorted(((i, k + 1, d, s) for (i, _), best in zip(ASKED, want) for k, (d, s) in enumerate(best)), key=repr)


def test_search_of_empty_tables(spark):
    docs, items = texts_of(spark, HARD), texts_of(spark, ASKED, "item_id")
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.filter("doc_id < 4"), items).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 6), st.integers(1, 9))
def test_max_score_is_the_ranking_by_all_lists(seed, k, window):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    m = rng.integers(25, 200, n)
    edges = np.append(np.arange(0, n, window), n)
    total, asked = np.zeros(n, np.int64), []
    for _ in range(int(rng.integers(1, 8))):
        places = np.flatnonzero(rng.random(n) < rng.random())
        if len(places):
            p = lexical.Postings(int(rng.integers(0, 4000)), places, rng.integers(1, 4, len(places)).astype(np.uint32), m, edges)
            q = int(rng.integers(1, 3))
            asked.append((q, p))
            total[places] += q * p.adds
    if asked:
        places, scores = lexical.max_score(asked, edges, k)
        assert (total[places] == scores).all() and len(set(places.tolist())) == len(places)
        want = np.flatnonzero((total > 0) & (total >= (np.sort(total)[-k] if n >= k else 1)))
        assert {*want.tolist()} <= {*places.tolist()}


def test_long_texts_are_cut_between_terms():
    text = LONG.encode() * 3
    assert list(lexical.pieces(text, 10**9)) == [text] and b"".join(lexical.pieces(text, 1000)) == text
    assert lexical.counted(text) == Counter(text.split()) == sum((lexical.counted(p) for p in lexical.pieces(text, 5000)), Counter())
    assert list(lexical.pieces(b"x" * 5000, 1000)) == [b"x" * 5000]


def misspelt(seed):
    rng = random.Random(seed)
    base = ["straight", "internal", "alphabet", "élégance", "interval", "straights", "aaaaaaa", "aaaaaaaa", "ababababa"]
    def one():
        w = rng.choice(base)
        k = rng.randrange(len(w) + 1)
        return rng.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("xy") + w[k + 1 :]])
    return [(i, " ".join(one() for _ in range(60))) for i in range(40)]


@pytest.mark.parametrize("shard_rows, crowd", [(50, 4), (100_000, 2000)])
def test_spelling_variants(spark, shard_rows, crowd):
    docs = [*misspelt(1), *HARD, (None, "Straight straight STRAIGHT"), (None, "Straight straight STRAIGHT"), (77, "q" * 20_000 + " " + "q" * 20_000)]
    got = spelling.spelling_variants(texts_of(spark, docs), shard_rows, crowd).collect()
    assert {r["word"]: tuple(r)[1:] for r in got} == plain_variants(docs) and len(got) == len(plain_variants(docs))
    assert any(r["form"] for r in got)


def test_spelling_of_empty_tables(spark):
    assert spelling.spelling_variants(texts_of(spark, [])).count() == 0
    assert spelling.spelling_variants(texts_of(spark, HARD[:3])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=3, max_size=3), min_size=1, max_size=6), st.lists(st.text("ab", min_size=2, max_size=4), min_size=1, max_size=6))
def test_one_edit_pairs(held, scanned):
    for size in (2, 3, 4):
        mine = [s for s in scanned if len(s) == size]
        if mine:
            got = {(int(i), int(j)) for i, j in zip(*spelling.one_edit_pairs(held, mine))}
            assert got == {(i, j) for i, h in enumerate(held) for j, s in enumerate(mine) if h != s and distance_one(h, s) and spelling.one_edit(h, s)}


def clustered(seed, n=300, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    rows = [(int(i), (centres[i % 8] + rng.normal(size=d) * rng.choice([0.1, 0.25, 0.4, 2.0])).tolist()) for i in range(n)]
    rows += [(n + k, [3 * x for x in rows[k][1]]) for k in range(5)] + [(n + 5 + k, rows[7][1]) for k in range(6)]
    rng.shuffle(rows)
    return [(int(i), v) for i, v in rows]


BAD = [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [1.0] * 23 + [None]), (2004, [float("nan")] * 24), (2005, [float("inf")] + [1.0] * 23), (None, None), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [5.0])]


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("cell", [20, vectors.CELL_ROWS])
def test_vectors(spark, kind, cell):
    rows = clustered(3)
    if kind == "float":
        rows = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    rows = [*rows, *BAD, (None, rows[0][1]), (None, rows[0][1]), rows[0], (3000, [1e200 if kind == "double" else 1e30] * 24)]
    table = spark.createDataFrame([(i, v, *[None] * 11) for i, v in rows], f"vec_id long, embedding array<{kind}>, {EXTRA}").repartition(3)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(table, cell_rows=cell).collect()), key=repr)
    assert got == sorted(((i, *r) for (i, _), r in zip(rows, plain_links(rows))), key=repr)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in vectors.near_vectors(table, cell_rows=cell).collect())


def test_no_vectors(spark):
    table = spark.createDataFrame(BAD, "vec_id long, embedding array<float>")
    assert vectors.near_vectors(table.limit(0)).count() == 0
    assert {r["n_links"] for r in vectors.near_vectors(table.filter("vec_id < 2006")).collect()} == {0}


def test_the_rotation_keeps_distances():
    unit = vectors.units(np.random.default_rng(1).normal(size=(50, 40)))
    turned = vectors.rotated(unit) * vectors.STEP
    assert turned.shape == (50, 64)
    assert np.allclose(turned @ turned.T, unit @ unit.T, atol=1e-4)
    assert (vectors.rotated(unit[:1]) == vectors.rotated(unit)[:1]).all()  # alone or among others
