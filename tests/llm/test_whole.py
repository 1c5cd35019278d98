"""Inputs on which an operator once did less than the whole job."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strideframe.llm import crowded_lists, dart_minhash, pii
from strideframe.llm.dart_minhash import components, near_duplicates
from strideframe.llm.decontamination import contamination
from strideframe.llm.html_text import main_text
from strideframe.llm.language_id import training_windows
from strideframe.llm.packing import pack_documents
from strideframe.llm.repeats import remove_repeats
from strideframe.llm.token_files import token_table

from . import brute


def test_components_of_long_chains(spark):
    n = 300
    shuffled = random.Random(1).sample(range(n), n)
    for path in ([0, *range(n, 0, -1)], shuffled):
        edges = spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")
        got = components(edges).collect()
        assert sorted(r["node"] for r in got) == sorted(path) and {r["root"] for r in got} == {0}


def test_a_shuffled_chain_of_edits_is_one_class(spark):
    n = 300
    ids = random.Random(2).sample(range(n), n)
    texts = [(i, " ".join(f"w{k}" for k in range(6 * at, 6 * at + 60))) for at, i in enumerate(ids)]
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute.near_classes(texts) == dict.fromkeys(range(n), 0)
    assert {r["class_size"] for r in got} == {n} and sum(r["kept"] for r in got) == 1


@pytest.mark.parametrize("address", [
    "j\u043ehn.smith@example.com", "john@example.c\u043em", "jo\u200bhn.smith@example.com", "john@exam\u200bple.com", "bob@mail.example [dot] com",
])
def test_a_disguised_address_is_found_whole(address):
    text = f"Write to {address} today."
    base, every = pii.all_spans(text)
    assert (9, 0, 9 + len(address)) in every and set(base) <= set(every)
    assert pii.redact(text) == "Write to [EMAIL] today."


def prose(word, n):
    return " ".join(f"The {word} of row {i}, it seems, goes on." for i in range(n))


def test_every_section_of_a_page_is_given_out():
    one, two, intro = ([prose(word, 5)] * n for word, n in (("tide", 13), ("moon", 4), ("sea", 3)))
    p = lambda texts: "".join(f"<p>{x}</p>" for x in texts)
    page = f"<body><div class=page>{p(intro)}<div class=one><h2>One</h2>{p(one)}</div><div class=two><h2>Two</h2>{p(two)}</div></div></body>"
    assert main_text(page) == "\n".join([*intro, "One", *one, "Two", *two])


@pytest.mark.parametrize("start, end", [
    ("<form id=aspnetForm>", "</form>"), ("<div class='site has-sidebar'>", "</div>"), ("<form><div class='has-header'>", "</div></form>"),
])
def test_a_marked_wrapper_does_not_hide_the_page(start, end):
    text = prose("tide", 20)
    page = f"<body>{start}<div class=nav><a href=x>Home</a></div><div class=body><h1>Title</h1><p>{text}</p></div><div class=comments><p>Well said, I think.</p></div>{end}</body>"
    assert main_text(page) == f"Title\n{text}"


def test_long_comments_stay_out_beside_an_article():
    text = prose("tide", 10)
    assert main_text(f"<body><main><article><p>{text}</p></article><div class=comments><p>{prose('reader', 20)}</p></div></main></body>") == text


LITERALS = [
    "one<|endoftext|>two", "plain words.", "<|startoftext|> a b <|endoftext|>", "A <|ENDOFTEXT|> b", "line\n<|endoftext|>\nline", "<|endoftext|", "more plain words",
]


def ids(name, text):
    return np.array([*Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids, 2], "<u4")


def test_added_tokens_in_texts(spark):
    docs = spark.createDataFrame(list(enumerate(LITERALS)), "doc_id long, text string")
    start = 0
    for r in sorted(token_table(docs).collect(), key=lambda r: r["doc_id"]):
        want = ids("byte_bpe_50k.json", LITERALS[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    pieces = pack_documents(docs).collect()
    assert {r["doc_id"] for r in pieces} == set(range(len(LITERALS)))
    for r in pieces:
        want = ids("word_bpe_49k.json", LITERALS[r["doc_id"]])
        assert r["doc_tokens"] == len(want)
        assert r["ids_crc32"] == zlib.crc32(want[r["start"] : r["start"] + r["length"]].tobytes())


def test_every_language_is_learned(spark):
    rows = [(i, f"words of language {i % 70}", f"l{i % 70:02d}") for i in range(700)]
    windows, labels, languages = training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages == [f"l{i:02d}" for i in range(70)]
    assert len(windows) == len(labels) and set(labels.tolist()) == set(range(70))


def seconds(work, text):
    begun = time.process_time()
    work(text)
    return time.process_time() - begun


@pytest.mark.parametrize("make", [
    lambda n: "<div>x " * n, lambda n: "<div>" * n + "</p>" * n, lambda n: "<a " * n, lambda n: "<b>" + "<div>" * n + "</b>" * n, lambda n: "<td><table>" + "<div>" * n + "<td>z</td>" * n,
    lambda n: '<div class="comment">x ' * n,
])
def test_pages_are_read_in_linear_time(make):
    assert seconds(main_text, make(100_000)) < 60  # hours if the work grew with the square


@pytest.mark.parametrize("make", [lambda n: "a dot " * n, lambda n: "a at a dot " * n, lambda n: "1" * n, lambda n: "1." * n, lambda n: "a@" * n, lambda n: "one " * n, lambda n: "a dot b at c dot de " * n])
def test_personal_data_is_found_in_linear_time(make):
    assert seconds(pii.all_spans, make(200_000)) < 60


def test_numbers_of_any_length_are_parts_of_addresses():
    assert pii.all_spans("0" * 5000 + ".1.2.3")[0] == [(0, 1, 5006)]


def templates(r):
    """(page, its main blocks): nested layouts, lists, comments, missing end tags, furniture by tag, role and name."""
    words = lambda n: " ".join(r.choice(["tide", "moon", "salt", "harbour", "lantern", "rope", "gull", "quay"], n))
    para = lambda: f"The {words(9)}, and the {words(7)}; it {words(6)}. So {words(8)}, they say."
    menu = "".join(f"<li><a href=/{i}>{words(1)}</a></li>" for i in range(6))
    paras, title = [para() for _ in range(6)], words(4)
    p = "".join(f"<p>{x}</p>" for x in paras)
    loose = "".join(f"<p>{x}" for x in paras)
    said = "".join(f"<li><p>I {words(5)}, truly.</p></li>" for _ in range(5))
    notes = [f"{words(6)}, {words(4)}." for _ in range(3)]
    yield f"<body><nav><ul>{menu}</ul></nav><main><article><h1>{title}</h1>{p}</article></main><footer>Copyright {words(5)}.</footer></body>", [title, *paras]
    yield f"<body><div class=wrap><div class='site-header'>{words(3)}</div><div class='main-nav'><ul>{menu}</ul></div><div id=content><h1>{title}</h1>{loose}</div><div class='left-sidebar'><p>{words(9)}.</p></div></div>", [title, *paras]
    yield f"<body><div class=page><h1>{title}</h1><div class=meta>by {words(2)}</div><div class=story>{p}</div><ol class='comment-list'>{said}</ol></div><div role=contentinfo>{words(6)}.</div>", [title, *paras]
    yield f"<body><form id=aspnetForm><div class=nav><a href=x>Home</a></div><div class=body><h2>{title}</h2>{p}<ul class=points>" + "".join(f"<li>{x}" for x in notes) + f"</ul></div><div class='cookie-banner'>{words(12)}, ok.</div></form>", [title, *paras, *notes]
    yield f"<body><table><tr><td class=menu><ul>{menu}</ul><td class=main><h1>{title}</h1>{p}</table><div class='ad-slot'>{words(9)}.</div>", [title, *paras]
    yield f"<article><header><h1>{title}</h1><p>{notes[0]}</p></header><div class=side-effects>{p}</div><aside>{para()}</aside><div hidden>{para()}</div></article><div class=comments>{said}</div>", [title, notes[0], *paras]


def test_blocks_of_labelled_pages():
    r = np.random.default_rng(11)
    right = found = wanted = 0
    for _ in range(20):
        for page, want in templates(r):
            got = main_text(page).split("\n")
            right += len(set(got) & set(want))
            found, wanted = found + len(set(got)), wanted + len(set(want))
    assert right / found > 0.95 and right / wanted > 0.97, (right / found, right / wanted)


def edited(r, base, n):
    words = list(base)
    for _ in range(n):
        words[r.randrange(len(words))] = f"z{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("weighting", ["log", "count", "binary"])
def test_a_group_of_near_copies_loses_no_link(spark, weighting):
    """Edits of one text, many of them just under the threshold to the pivot, with a repeated line."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(110)] + "a line that stands here often".split() * 8
    rows = [(i, edited(r, base, r.randrange(14))) for i in range(250)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), weighting=weighting).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == brute.near_classes(rows, weighting=weighting)


def test_wide_and_narrow_bitmaps_give_the_same(spark):
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(60)}" for _ in range(40))) for i in range(80)]
    items = [(k, " ".join(rows[k * 7][1].split()[5:5 + n])) for k, n in enumerate((1, 2, 5, 13, 20, 30))]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for bits in (64, 1 << 22):
        got = {x["doc_id"]: tuple(x)[1:] for x in contamination(docs, asked, bits=bits).collect()}
        assert got == brute.contaminated(rows, items)


@pytest.mark.parametrize("large", [0, 3])
def test_anchors_sorted_over_the_cluster_give_the_same(spark, large):
    r = random.Random(8)
    line = "".join(r.choice("abc ") for _ in range(140))
    rows = [(i, "".join(r.choice("xyz") for _ in range(r.randrange(60))) + line[r.randrange(20):] + "".join(r.choice("xyz") for _ in range(50))) for i in range(60)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), large_anchor=large).collect()
    assert {x["doc_id"]: tuple(x)[1:] for x in got} == brute.repeats(rows)


def templated(n, seed=1):
    r = random.Random(seed)
    base = [f"t{i}" for i in range(110)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(r.randrange(2, 5)):
            words[r.randrange(110)] = f"e{r.randrange(10**6)}"
        out.append((i, " ".join(words)))
    return out


def test_candidates_of_a_template_grow_in_proportion(spark, monkeypatch):
    """Texts of one template that are mostly not similar: every two share common shingles, but pairs are not given out."""
    made = {}
    for module in (dart_minhash, crowded_lists):
        def spy(df, name, staged=module.staged):
            out = staged(df, name)
            made.setdefault(name, []).append(out.count())
            return out

        monkeypatch.setattr(module, "staged", spy)
    largest = []
    for n in (700, 1400):
        made.clear()
        docs = templated(n)
        got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert n > 1000 or got == brute.near_classes(docs)
        largest.append({k: max(v) for k, v in made.items()})
    for name in ("candidates", "list-members", "prefixes", "measured", "placed", "pivot-pairs"):
        assert largest[1][name] <= 2.6 * largest[0][name] + 100 and largest[1][name] < 40 * 1400, name


def test_common_counts_are_those_of_sets(monkeypatch):
    r = np.random.default_rng(3)
    for _ in range(60):
        monkeypatch.setattr(crowded_lists, "COUNTS_AT_ONCE", int(r.integers(1, 60)))
        u = int(r.integers(2, 50))
        left, right = ([r.permutation(u)[: r.integers(0, u)] * 7919 for _ in range(int(r.integers(1, 14)))] for _ in range(2))
        assert (crowded_lists.common_counts(left, right) == [[len({*a.tolist()} & {*b.tolist()}) for b in right] for a in left]).all()


def test_blocks_of_a_list_meet_each_other(spark, monkeypatch):
    """Lists dealt into several blocks give the classes that brute force gives."""
    monkeypatch.setattr(crowded_lists, "BLOCK_SETS", 20)
    docs = templated(160, 5)
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.near_classes(docs)


def test_what_belongs_to_an_article_stays_and_the_rest_goes():
    page = """<html><body><nav><ul><li><a href=x>Home</a></li><li><a>News</a></li></ul></nav><article><h1>T</h1><p>First paragraph, with a lot of text in it. It goes on, and on.</p>
        <ul><li><a href=a>This linked sentence belongs to the article itself.</a></li><li><a href=c>And a third one, which is linked too.</a></li></ul>
        <p>The formula <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> stands here, and the text ends.</p>
        <div class="related-posts"><p>You may also like this, and that, and other things.</p></div></article>
        <section><p>A reader says: I liked it, really. Thanks for writing.</p><p>Another one says: so did I, very much.</p></section><footer>c</footer></body></html>"""
    assert main_text(page).split("\n") == [
        "T", "First paragraph, with a lot of text in it. It goes on, and on.", "This linked sentence belongs to the article itself.", "And a third one, which is linked too.",
        "The formula E=mc2 stands here, and the text ends.",
    ]


def test_pages_without_an_article_keep_their_sections():
    page = """<html><body><div class=top><a href=/>Home</a></div><div id=main-text><div><h2>One</h2><p>The first section says this, and that. It is long enough to count, surely.</p></div>
        <div><h2>Two</h2><p>The second section goes on, with more of the same; it ends here.</p></div></div><div class=sidebar><p>Popular now, and ever.</p></div></body></html>"""
    assert main_text(page).split("\n") == [
        "One", "The first section says this, and that. It is long enough to count, surely.", "Two", "The second section goes on, with more of the same; it ends here.",
    ]
