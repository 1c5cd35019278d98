"""Each query over its whole table, held against a plain version."""

import html
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from strideframe.llm import language_id, toxicity
from strideframe.llm.registry import oracle_sql, queries

from . import brute
from .test_edges import plain_probabilities


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def rows(spark, sf, name):
    return queries()[name](spark, sf).collect()


LIBRARY = {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def tokens(name, text):
    return np.array([*LIBRARY[name].encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_personal_data(spark, sf, docs):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op1_deobfuscation")}
    assert len(got) == len(docs)
    for i, text in docs:
        base = brute.personal(text)
        assert got[i]["base_sha256"] == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [got[i][f"n_{k}"] for k in brute.PATTERNS] == [sum(x[0] == k for x in base) for k in brute.PATTERNS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= {*got[i]["spans"].split(",")}


def test_near_duplicates(spark, sf, docs):
    got = rows(spark, sf, "op2_dart_minhash")
    want = brute.near_classes(docs)
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_languages(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = rows(spark, sf, "op3_byte_gru")
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert np.mean(right) > 0.9


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(want, key=repr)


def test_contamination(spark, sf, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in rows(spark, sf, "op4_prefix_filter")}
    assert got == brute.contaminated(docs, items)


def test_exact(spark, sf, docs):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows(spark, sf, "op5_content_sort")}
    assert got == brute.exact_groups(docs)


def plain_article(page):
    """The text of the one article of a page of this table, by cutting it at its block elements."""
    inner = re.search(r"<article>(.*)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1|h2|h3|div|ul|ol|li|pre|table|tr|td)\b[^>]*>", inner[1].replace("<br>", " ")) if inner else []
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", q)).split()) for q in parts) if x)


def test_pages(spark, sf):
    for folder in (sf, sf.replace("0.001", "0.01")):
        got = {r["page_id"]: r for r in rows(spark, folder, "op6_tag_paths")}
        pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
        assert len(got) == len(pages)
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        assert all(got[p["page_id"]]["text"] == plain_article(p["html"]) for p in pages)


def test_token_files(spark, sf, docs):
    got = {r["doc_id"]: r for r in rows(spark, sf, "op7_simple8b")}
    start = 0
    for i, text in sorted(docs):
        ids = tokens("byte_bpe_50k.json", text)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def check_packing(got, docs):
    want = {i: tokens("word_bpe_49k.json", text) for i, text in docs}
    pieces, windows = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == want.keys()
    for i, mine in pieces.items():
        at = 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want[i])
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(want[i][r["start"] : at].tobytes())
        assert at == len(want[i])
    padded = 0
    for mine in windows.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded <= 0.01 * sum(map(len, want.values()))


def test_packing(spark, sf, docs):
    check_packing(rows(spark, sf, "op8_karmarkar_karp"), docs)


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    pos = np.array(labels) == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("size, least", [("0.01", 0.9), ("0.1", 0.95)])
def test_toxicity(spark, size, least):
    sf = f"/root/testdata/sf{size}"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in rows(spark, sf, "op9_counterfactual") if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert auc([r["score"] for r in got], [labels[r["doc_id"]] for r in got]) > least
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_scores_and_languages_are_those_of_the_models(spark, sf, docs):
    """Both queries against plain scoring by the same models."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    weights, bias = model = toxicity.fit(table, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table, table, model).collect()}
    for i, text in docs:
        found = {f for w in re.findall(r"[^\W\d_]+", (text or "").lower()) for f in [w, *(w[:k] + "*" for k in range(5, 9) if len(w) > k)]}
        assert got[i] == pytest.approx(1 / (1 + np.exp(-bias - sum(weights.get(f, 0.0) for f in found))))
    params, languages = model = language_id.fit(table)
    got = {r["doc_id"]: r for r in language_id.identify_languages(table, model).collect()}
    for i, text in sorted(docs, key=lambda x: len(x[1] or ""))[:60]:
        if text and language_id.LETTER.search(text):
            want = plain_probabilities(params, text.encode())
            assert got[i]["score"] == pytest.approx(want.max(), abs=1e-4) and got[i]["lang_pred"] == languages[int(want.argmax())]


def test_repeats(spark, sf, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(spark, sf, "op10_longest_previous_factor")}
    assert got == brute.repeats(docs)


def test_pipeline(spark, sf, docs):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.language_id(spark, table, sf).collect()]
    groups = brute.exact_groups(kept)
    kept = [(i, t) for i, t in kept if groups[i][0] == i]
    classes = brute.near_classes(kept)
    kept = [(i, t) for i, t in kept if classes[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = brute.contaminated(kept, items)
    kept = [(i, t) for i, t in kept if not found[i][4]]
    assert len(docs) > len(kept) > 0.3 * len(docs)
    check_packing(rows(spark, sf, "pipeline"), kept)
