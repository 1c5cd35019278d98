"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables; small kernels."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
import strideframe.llm.language_id as lid
from strideframe.llm import packing, pii, repeats, simple8b, toxicity
from strideframe.llm.dart_minhash import near_duplicates
from strideframe.llm.decontamination import contamination
from strideframe.llm.exact_dedup import exact_dedup, keep_one
from strideframe.llm.html_text import extract_main_text, main_text
from strideframe.llm.packing import pack_documents
from strideframe.llm.pii import find_personal_data
from strideframe.llm.repeats import remove_repeats
from strideframe.llm.token_files import token_table

from . import brute

LONG = " ".join(f"w{i * 7919 % 9973}" for i in range(30_000))
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, LONG + " end"), (6, "a b c"), (7, "a  b\nc"), (8, "ééé … 日本"), (9, "x" * 300), (10, "mail bob@ex.org or bob [at] ex [dot] org")]
ITEMS = [(1, "a b c"), (2, None), (3, ""), (4, " ".join(LONG.split()[100:140])), (4, "b"), (None, "ééé")]
#: Columns whose names the operators use themselves.
EXTRA = (
    "doc_id long, text string, keep_id string, kept int, token string, band int, norm string, spans string, class_id double, lang string, key int, row int, "
    "rep int, part int, run int, text_key string, bad_id int, k_id int, k_twice int, items int, n_words int, label int, toxic string, held_out int, doc_words int, _sha int, _first int"
)


def frame(spark, rows):
    return spark.createDataFrame([_row(i, t) for i, t in rows], EXTRA)


def _row(i, t):
    kinds = [x.split()[1] for x in EXTRA.split(", ")][2:]
    return (i, t, *({"string": "en", "int": 1, "double": 0.5}[k] for k in kinds))


def items_of(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, n_words int")


def labels_of(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(12)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda spark, docs: find_personal_data(docs),
    "op2": lambda spark, docs: near_duplicates(docs),
    "op3": lambda spark, docs: lid.identify_languages(docs),
    "op4": lambda spark, docs: contamination(docs, items_of(spark)),
    "op5": lambda spark, docs: exact_dedup(docs),
    "op7": lambda spark, docs: token_table(docs),
    "op8": lambda spark, docs: pack_documents(docs),
    "op9": lambda spark, docs: toxicity.score_toxicity(docs, labels_of(spark)),
    "op10": lambda spark, docs: remove_repeats(docs),
}
#: Rows without ids, repeated rows, null, empty and long texts, ties.
HARD = [*TEXTS, (None, None), (None, ""), (None, "a b c"), (None, "a b c"), (None, LONG), (6, "a b c"), (6, "a b c"), (11, "a b c"), (12, "x" * 300), (None, "x" * 300), (1, "two texts of one id")]


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    got = OPERATORS[name](spark, frame(spark, HARD)).collect()
    ids = [r["doc_id"] for r in got]
    order = lambda x: (x is None, x or 0)
    if name == "op8":
        assert {*ids} == {i for i, _ in HARD}
    else:
        assert sorted(ids, key=order) == sorted((i for i, _ in HARD), key=order)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, frame(spark, [])).count() == 0


def test_html_of_hard_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p", "x"), (3, "u", "<p>One, two.</p>", "x"), (3, "u", "<p>One, two.</p>", "x"), (4, "u", "<p>" + LONG + "</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in extract_main_text(pages).collect()]
    assert got == [(1, "", 0), (2, "", 0), (None, "", 0), (3, "One, two.", 9), (3, "One, two.", 9), (4, LONG, len(LONG))]
    assert extract_main_text(pages.limit(0)).count() == 0


def stage(spark, tmp_path_factory, name, rows):
    folder = tmp_path_factory.mktemp("bench")
    items_of(spark).write.parquet(f"{folder}/benchmark.parquet")
    return dict(corpus_pipeline.STAGES)[name](spark, frame(spark, rows), str(folder))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_hard_rows(spark, tmp_path_factory, name):
    out = stage(spark, tmp_path_factory, name, HARD)
    got = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {i for i, _ in HARD}
        return
    assert out.columns == [x.split()[0] for x in EXTRA.split(", ")]
    assert all(tuple(r) == _row(r["doc_id"], r["text"]) for r in got)  # no column is touched
    texts = [(r["doc_id"], r["text"]) for r in got]
    if name == "language_id":
        assert all(t and lid.LETTER.search(t) for _, t in texts)
    if name == "exact_dedup":
        norm = [brute.BLANK.sub("", t or "") for _, t in texts]
        assert len(set(norm)) == len(norm) and {*norm} == {brute.BLANK.sub("", t or "") for _, t in HARD}
    if name == "near_dedup":
        named = list(enumerate(t for _, t in HARD))
        classes = brute.near_classes(named)
        of = {t: classes[k] for k, t in named if brute.words(t)}
        mine = [of[t] for _, t in texts if t in of]
        assert sorted(mine) == sorted(set(of.values()))
        assert sum(not brute.words(t) for _, t in texts) == sum(not brute.words(t) for _, t in HARD)
    if name == "decontamination":
        verdict = brute.contaminated(list(enumerate(t for _, t in HARD)), ITEMS)
        assert sorted(texts, key=repr) == sorted((r for k, r in enumerate(HARD) if not verdict[k][4]), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, tmp_path_factory, name):
    assert stage(spark, tmp_path_factory, name, []).count() == 0


def test_edges_against_plain_versions(spark):
    docs = frame(spark, TEXTS)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup(docs).collect()} == brute.exact_groups(TEXTS)
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()} == brute.near_classes(TEXTS)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs).collect()} == brute.repeats(TEXTS)
    got = contamination(docs, items_of(spark)).collect()
    want = brute.contaminated(TEXTS, [(i, t) for i, t in ITEMS if i is not None])
    for r in got:  # windows of items without an id count, but name no item
        assert (r["n_words"], r["n_items"], r["items_sha256"]) == (want[r["doc_id"]][0], *want[r["doc_id"]][2:4])
    assert next(r for r in got if r["doc_id"] == 8)["n_hit"] == 1
    found = {r["doc_id"]: r["spans"] for r in find_personal_data(docs).collect()}
    assert found[1] == found[2] == "" and found[10] == "email:5:15,email:19:40"
    assert {r["doc_id"]: r["n_tokens"] for r in token_table(docs).collect()}[1] == 1


def test_rows_without_ids(spark):
    docs = frame(spark, [(None, "same"), (None, "sa me"), (2, "same"), (None, "other"), (None, LONG), (None, LONG)])
    got = exact_dedup(docs).collect()
    assert sorted(r["group_size"] for r in got) == [1, 2, 2, 3, 3, 3] and sum(r["kept"] for r in got) == 3
    near = near_duplicates(docs).collect()
    assert sorted(r["class_size"] for r in near) == [1, 1, 2, 2, 2, 2] and sum(r["kept"] for r in near) == 4
    assert {r["class_id"] for r in near if r["class_size"] == 2} == {2, None}
    item = " ".join(LONG.split()[100:140])
    hit = contamination(frame(spark, [(None, item), (None, "clean words")]), items_of(spark)).collect()
    assert sorted((r["n_words"], r["contaminated"]) for r in hit) == [(2, False), (40, True)]
    later = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in remove_repeats(frame(spark, [(None, LONG), (5, LONG), (None, "y" * 99)])).collect()}
    plain = brute.repeats([(5, LONG), (6, LONG)])  # the long text repeats itself too
    assert later == {(5, len(LONG)): plain[5][1], (None, len(LONG)): plain[6][1], (None, 99): 0}
    ids = [r["doc_id"] for r in token_table(docs).orderBy("start").collect()]
    assert ids == [2, None, None, None, None, None]


def test_repeated_rows(spark):
    docs = frame(spark, [(1, "same"), (1, "same"), (2, "same")])
    got = exact_dedup(docs).collect()
    assert len(got) == 3 and sum(r["kept"] for r in got) == 1 and {r["group_size"] for r in got} == {3}
    assert keep_one(docs).count() == 1
    assert token_table(docs).count() == 3 and find_personal_data(docs).count() == 3 and near_duplicates(docs).count() == 3


def test_languages_of_texts_without_letters(spark):
    rows = [(i, f"the words of it number {i}", "en") for i in range(60)] + [(100 + i, f"les mots de la ligne {i}", "fr") for i in range(60)]
    rows += [(300, None, "en"), (301, "", "fr"), (302, "12 + 3 = 15 …", "en"), (303, "the", None)]
    got = {r["doc_id"]: r for r in lid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (300, 301, 302))
    assert got[303]["lang_pred"] in ("en", "fr") and 0 < got[303]["score"] <= 1
    bare = lid.identify_languages(spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")).collect()
    assert [(r["lang_pred"], r["score"]) for r in bare] == [("und", 0.0)]


PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>
<article><h1>A title</h1><p>First   paragraph, with &amp; sign. It goes on, and on.</p><p>Second one, also long enough; it ends.</p></article>
<div class="comments"><p>A reader, who comments at length. Yes.</p></div><footer>Copyright</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "A title\nFirst paragraph, with & sign. It goes on, and on.\nSecond one, also long enough; it ends."


@settings(max_examples=300, deadline=None)
@given(st.text("a1.@-+ 25(", max_size=40))
def test_base_spans_are_the_contract(text):
    assert [(pii.KINDS[k], a, b) for a, k, b in pii.base_spans(text)] == brute.personal(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", " dot ", " at ", "@", "one ", "two ", "о", "​", " [at] ", "7", "."]), max_size=14))
def test_rewritten_spans_lie_in_the_source(parts):
    text = "".join(parts)
    base, every = pii.all_spans(text)
    assert {*base} <= {*every} and all(0 <= a < b <= len(text) for a, _, b in every)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**17), st.integers(0, 2**64 - 1)), max_size=1500))
def test_simple8b_round_trip(values):
    x = np.array(values, np.uint64)
    assert (simple8b.decode(*simple8b.encode(x), len(x)) == x).all()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 12))
def test_longest_previous_factors(data, cut):
    """Against the definition, for all suffixes that have ``cut`` bytes left."""
    data = bytes(b % 3 for b in data)
    n = len(data) - cut + 1
    if n < 1:
        return
    raw = np.frombuffer(data, np.uint8)
    levels = repeats.suffix_levels(raw, cut)
    order = np.lexsort((np.arange(n), levels[-1][1][:n]))
    assert [data[i : i + cut] for i in order] == sorted(data[i : i + cut] for i in range(n))
    shared = np.zeros(n, np.int64)
    shared[1:] = repeats.common_prefixes(raw, levels, order[:-1], order[1:], cut)
    got = dict(zip(order.tolist(), repeats.longest_previous_factors(order, shared).tolist()))
    for i in range(n):
        want = 0
        for j in range(i):
            k = 0
            while k < cut and data[i + k] == data[j + k]:
                k += 1
            want = max(want, k)
        assert got[i] == want


def plain_probabilities(p, text):
    """The network position by position, with plain loops over time."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, sums, n = p["u"].shape[2], 0.0, 0
    for lo in range(0, len(text), lid.WINDOW):
        window = text[lo : lo + lid.WINDOW].ljust(lid.WINDOW, b"\0")
        states = {}
        for d in (0, 1):
            s = np.zeros(h)
            for t in range(lid.WINDOW) if d == 0 else range(lid.WINDOW - 1, -1, -1):
                x, g = p["x"][d][:, window[t]].astype(float), p["u"][d].astype(float) @ s
                r, z = sigmoid(x[:h] + g[:h]), sigmoid(x[h : 2 * h] + g[h : 2 * h])
                c = np.tanh(x[2 * h :] + r * g[2 * h :])
                s = (1 - z) * c + z * s
                states[d, t] = s
        for t in range(lid.WINDOW):
            if window[t]:
                logits = p["v"].astype(float) @ np.concatenate([states[0, t], states[1, t]]) + p["b"][:, 0]
                e = np.exp(logits - logits.max())
                sums, n = sums + e / e.sum(), n + 1
    return sums / n


def test_document_probabilities_are_the_plain_recurrence():
    p = lid.start_params(3, 4)
    texts = [b"short", bytes(range(1, 256)) * 2, "déjà vu — 日本".encode()]
    assert np.allclose(lid.document_probabilities(p, texts), [plain_probabilities(p, t) for t in texts], atol=1e-5)


def test_gru_gradients():
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lid.start_params(3, 4).items()}
    windows, labels = r.integers(1, 256, (5, 7)).astype(np.uint8), r.integers(0, 3, 5)
    _, g = lid.loss_and_gradients(p, windows, labels)
    for k in p:
        at = tuple(np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
        eps, old = 1e-3, p[k][at]
        p[k][at] = old + eps
        high = lid.loss_and_gradients(p, windows, labels)[0]
        p[k][at] = old - eps
        low = lid.loss_and_gradients(p, windows, labels)[0]
        p[k][at] = old
        assert (high - low) / (2 * eps) == pytest.approx(g[k][at], rel=0.05)


def test_group_names_do_not_move_scores():
    index = {"awful": 0, "muslims": 1, "christians": 2}
    texts = [({"muslims", "awful"}, 1)] * 20 + [({"muslims"}, 1)] * 5 + [({"christians"}, 0)] * 20 + [(set(), 0)] * 40
    xs = [sorted(index[w] for w in t if w in index) for t, _ in texts]
    pairs = [(i, sorted(index[w] for w in c if w in index)) for i, (t, _) in enumerate(texts) for c in toxicity.counterfactuals(t)]
    free, _ = toxicity.train(xs, [y for _, y in texts], [], 3)
    held, _ = toxicity.train(xs, [y for _, y in texts], pairs, 3, penalty=5.0)
    assert abs(held[1] - held[2]) < 0.5 * abs(free[1] - free[2])


def test_neutral_mentions_are_not_toxic(spark):
    """Where toxic texts name groups more often than others do, the penalty takes back the false positives on neutral mentions."""
    r = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(200)]
    say = lambda *more: " ".join([*r.choice(plain, 20), *more])
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        name = r.choice(["muslims", "refugees", "ausländer", "juifs"]) if r.random() < (0.8 if toxic else 0.03) else "table"
        rows.append((i, say(r.choice(["scum", "trash"]) if toxic and r.random() < 0.8 else "chair", name)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = [say("muslims"), say("refugees"), say("ausländer"), say("juifs")] * 10
    insults = [say("scum"), say("trash")] * 10
    rate = {}
    for penalty in (0.0, 5.0):
        scorer = toxicity.Scorer(toxicity.fit(docs, known, penalty))
        rate[penalty] = np.mean([scorer.score(t) >= toxicity.THRESHOLD for t in neutral])
        assert np.mean([scorer.score(t) >= toxicity.THRESHOLD for t in insults]) > 0.9
    assert rate[0.0] > 0.5 and rate[5.0] < 0.1


def test_windows_rise_and_are_near_equal():
    r = np.random.default_rng(0)
    pieces = [(i, 0, int(n)) for i, n in enumerate(np.minimum(4095, r.lognormal(5.5, 1.2, 400) + 1))]
    loads = [sum(p[2] for p in w) for w in packing.near_equal(pieces, 4096)]
    assert max(loads) <= 4096 and max(loads) - min(loads) < 0.05 * 4096
    assert len(packing.near_equal([(i, 0, 60) for i in range(9)], 100)) == 9  # six would hold the total


@pytest.mark.parametrize("cut", [True, False])
def test_packing_with_and_without_cuts(spark, cut):
    rows = [(i, "some words of a text " * (i * 37 % 90)) for i in range(300)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=256, cut=cut).collect()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    by_doc, by_window = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert all(sum(r["length"] for r in w) <= 256 for w in by_window.values())
    if not cut:
        assert all(len(by_doc[i]) == 1 for i, ids in want.items() if len(ids) < 256)
