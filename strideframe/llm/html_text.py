"""Main text of web pages by tag-path ratios.

A page is cut into blocks. For every root-to-leaf path of block elements (tags and classes), text length and
punctuation are summed and divided by the number of its blocks; both series are smoothed along the page and
fused by their product, the share of text that is not link text, and a factor for paths that are page
furniture by name. Paths above the threshold are content nodes: their blocks are kept wherever they lie. The
element that holds most of their text also keeps its blocks of other paths, unless they are mostly links or
furniture, and headings that introduce kept blocks are kept. Only what HTML itself sets apart (menus, footers,
asides, page headers, hidden elements) is left out before, and not if it holds most of the page's text; on a
page with an article, so is what stands outside of it under a furniture name.

Every step is linear in the page: elements, paths and open tags are numbered, and sums go up the tree once.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?P<shut>-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|textarea|select|title)\b(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?P<rawshut></(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
TAIL = re.compile(r"<[a-zA-Z!/?]")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""")
READ = {"class", "id", "role", "hidden", "style", "aria-hidden"}
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?。，、！？；：…]")

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img "
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split()
)
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LEVEL_STOPS = {"ul", "ol", "dl", "table", "menu", "nav"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Set apart by HTML itself; a header counts outside articles only.
FURNITURE = set("head nav footer aside button menu dialog header fieldset input".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Names of page furniture. A class or id counts if it is one of them, if its last part is ("site-footer"), or if its first
#: part is and its last is a word for a box ("comment-list").
FURNITURE_WORDS = set(
    "nav navbar navigation menu menubar topbar breadcrumb breadcrumbs header masthead banner footer colophon copyright sidebar aside widget widgets "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login form search "
    "pagination pager skip".split()
)
BOX_WORDS = set("list bar box area block section container wrapper wrap inner slot item items link links panel group text body content unit message banner notice thread holder posts stories articles reads news".split())
#: A name that says what a page has, not what an element is.
STATES = {"has", "no", "with", "without", "is", "js", "hide", "show"}
#: What a furniture name, and a form, leave of a path's fused ratio.
NAMED, IN_FORM = 0.02, 0.2
#: A path is content from this share of the best fused ratio on.
THRESHOLD = 0.1
#: Elements set apart by HTML that hold more than this share of the page's text without links are not left out, unless
#: an article or main element outside of them holds text.
MOST = 0.5
#: Where an article or main element holds this share of the text, sections outside of it are no part of it.
WITHIN = 0.5
#: Link text reads like a sentence, not like a menu, if it ends like one or has so many words.
SENTENCE = re.compile(r"[.!?…。！？][\"'”’)]*$")
SENTENCE_WORDS = 8
#: The element that holds this share of the content keeps its other blocks too.
HOLDS = 0.6


def _attributes(text: str) -> dict[str, str]:
    if not text:
        return {}
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        name = m[1].lower()
        if name in READ and name not in found:
            found[name] = (m[2] or "").strip("\"'").lower()
    return found


def _named(names: str) -> bool:
    """Whether a class or id attribute names page furniture."""
    for name in names.split():
        parts = re.split(r"[-_]+", name.strip("-_"))
        if parts[0] in STATES:
            continue
        if parts[-1] in FURNITURE_WORDS or (parts[0] in FURNITURE_WORDS and parts[-1] in BOX_WORDS):
            return True
    return False


def _apart(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    return (tag in FURNITURE and not (tag == "header" and inside)) or attrs.get("role") in FURNITURE_ROLES


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")


class Page:
    """The elements of a page, numbered in page order with 0 as the root, and its blocks of text."""

    def __init__(self, page: str) -> None:
        self.parent, self.tag, self.path = [-1], [""], [0]
        #: set apart by HTML; hidden; factor of names; in an article or main element
        self.apart, self.hidden, self.factor, self.inside = [False], [False], [1.0], [False]
        self._paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of link text
        self._node, self._links, self._n_link = 0, 0, 0
        self._buffer: list[str] = []
        #: open elements as (tag, element), inline ones with the element they stand in
        self._open: list[tuple[str, int]] = [("", 0)]
        self._blocks_open: Counter[str] = Counter()
        #: for each open block element its place in _open, its inline tags, and the nearest open item or list
        self._frames: list[tuple[int, Counter[str], int]] = [(0, Counter(), -1)]
        self._read(page)

    def _flush(self) -> None:
        if self._buffer:
            text = SPACE.sub(" ", "".join(self._buffer)).strip()
            if text:
                self.blocks.append((self._node, text, min(self._n_link, len(text))))
            self._buffer.clear()
        self._n_link = 0

    def _say(self, text: str) -> None:
        text = html.unescape(text)
        self._buffer.append(text)
        if self._links:
            self._n_link += len(text.strip())

    def _close(self, frame: int) -> None:
        """Closes the block element of a frame and all that is open in it."""
        self._flush()
        place = self._frames[frame][0]
        self._links -= sum(1 for t, _ in self._open[place:] if t == "a")
        for f in self._frames[frame:]:
            self._blocks_open[self._open[f[0]][0]] -= 1
        del self._open[place:], self._frames[frame:]
        self._node = self._open[self._frames[-1][0]][1]

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            if self._frames[-1][1][tag]:
                while True:
                    t, _ = self._open.pop()
                    self._frames[-1][1][t] -= 1
                    self._links -= t == "a"
                    if t == tag:
                        return
        elif self._blocks_open[tag]:
            frame = len(self._frames) - 1
            while self._open[self._frames[frame][0]][0] != tag:
                frame -= 1
            self._close(frame)
        else:
            self._flush()

    def _start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag == "br":
                self._buffer.append(" ")
            elif tag not in INLINE:
                self._flush()
            return
        if tag in INLINE:
            self._open.append((tag, self._node))
            self._frames[-1][1][tag] += 1
            self._links += tag == "a"
            return
        if tag in CLOSES_P and self._open[self._frames[-1][0]][0] == "p":
            self._close(len(self._frames) - 1)
        elif tag in SAME_LEVEL:
            frame = self._frames[-1][2]
            while frame > 0 and (t := self._open[self._frames[frame][0]][0]) not in LEVEL_STOPS:
                if t in SAME_LEVEL[tag]:
                    self._close(frame)
                    break
                frame = self._frames[frame - 1][2]
        self._flush()
        attrs, up = _attributes(attributes), self._node
        key = (self.path[up], tag + "".join("." + x for x in attrs.get("class", "").split()))
        path = self._paths.setdefault(key, len(self._paths) + 1)
        named = tag not in ("html", "body", "article", "main") and (_named(attrs.get("class", "")) or _named(attrs.get("id", "")))
        self._node = len(self.parent)
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(path)
        self.apart.append(_apart(tag, attrs, self.inside[up]))
        self.hidden.append(self.hidden[up] or _hidden(attrs))
        self.factor.append(min(self.factor[up], NAMED if named else IN_FORM if tag == "form" else 1.0))
        self.inside.append(self.inside[up] or tag in ("article", "main"))
        self._open.append((tag, self._node))
        self._blocks_open[tag] += 1
        level = len(self._frames) if tag in SAME_LEVEL or tag in LEVEL_STOPS else self._frames[-1][2]
        self._frames.append((len(self._open) - 1, Counter(), level))

    def _read(self, page: str) -> None:
        at, stop = 0, page.rfind(">") + 1  # no tag ends after the last sign
        cut = False
        for m in TOKEN.finditer(page, 0, stop):
            if m.start() > at:
                self._say(page[at : m.start()])
            at = m.end()
            cut = m["shut"] == "" or m["rawshut"] == ""
            if tag := m["tag"] or m["tag2"]:
                if m["end"] or m["end2"]:
                    self._end(tag.lower())
                else:
                    self._start(tag.lower(), m["attrs"] or m["attrs2"] or "")
        if not cut and at < len(page):
            tail = TAIL.search(page, max(at, stop))
            self._say(page[at : tail.start() if tail else len(page)])
        self._flush()

    def sums(self, own: np.ndarray) -> np.ndarray:
        """What each element and all below it hold; children come after their parents."""
        total = own.tolist()
        for i in range(len(total) - 1, 0, -1):
            total[self.parent[i]] += total[i]
        return np.array(total)

    def below(self, marked: list[bool]) -> list[bool]:
        """Whether each element or one above it is marked."""
        out = list(marked)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parent[i]]
        return out


def _without_furniture(page: Page) -> list[tuple[int, str, int]]:
    blocks = [b for b in page.blocks if not page.hidden[b[0]]]
    plain = np.zeros(len(page.parent))
    for node, text, n_link in blocks:
        plain[node] += len(text) - n_link
    held, total = page.sums(plain), plain.sum()
    apart = page.below(page.apart)
    if any(page.inside[i] and not apart[i] and plain[i] for i in range(len(plain))):  # beside an article, names decide too
        kept = [b for b in blocks if not apart[b[0]] and (page.inside[b[0]] or page.factor[b[0]] > NAMED)]
        inside = sum(len(t) - n for i, t, n in kept if page.inside[i])
        if inside >= WITHIN * sum(len(t) - n for _, t, n in kept):  # titles may stand before it
            kept = [b for b in kept if page.inside[b[0]] or page.tag[b[0]] in HEADINGS]
        return kept
    apart = page.below([a and not h > MOST * total for a, h in zip(page.apart, held)])
    return [b for b in blocks if not apart[b[0]]]


def content_paths(page: Page, blocks: list[tuple[int, str, int]]) -> set[int]:
    """The paths whose smoothed and fused ratios of text and punctuation reach the threshold."""
    order: dict[int, int] = {}
    rows: list[list[float]] = []  # text, punctuation, link text, blocks, factor
    for node, text, n_link in blocks:
        i = order.setdefault(page.path[node], len(order))
        if i == len(rows):
            rows.append([0, 0, 0, 0, page.factor[node]])
        for k, v in enumerate((len(text), len(PUNCTUATION.findall(text)), n_link, 1)):
            rows[i][k] += v
    length, marks, linked, n, factor = np.array(rows, float).T

    def smooth(x: np.ndarray) -> np.ndarray:
        return 0.8 * x + 0.1 * np.append(x[1:], x[-1]) + 0.1 * np.append(x[0], x[:-1])

    fused = smooth(length / n) * (smooth(marks / n) + 0.1) * (1 - linked / length) * factor
    return {path for path, i in order.items() if fused[i] >= THRESHOLD * fused.max()}


def _sentence(text: str) -> bool:
    return bool(SENTENCE.search(text)) or len(text.split()) >= SENTENCE_WORDS


def main_text(source: str) -> str:
    page = Page(source)
    blocks = _without_furniture(page)
    if not blocks:
        return ""
    content = content_paths(page, blocks)
    chosen = [page.path[node] in content for node, _, _ in blocks]
    own = np.zeros(len(page.parent))
    for is_content, (node, text, _) in zip(chosen, blocks):
        own[node] += len(text) * is_content
    held, total = page.sums(own), own.sum()
    best, deepest = 0, 0
    depth = [0] * len(page.parent)
    for i in range(1, len(depth)):
        depth[i] = depth[page.parent[i]] + 1
        if held[i] >= HOLDS * total and depth[i] > deepest:
            best, deepest = i, depth[i]
    while page.tag[best] in HEADINGS or page.tag[best] in ("p", "li", "td", "pre", "blockquote", "dd"):
        best = page.parent[best]
    outer = [t == "article" and not page.inside[page.parent[i]] for i, t in enumerate(page.tag)]
    in_best = page.below([i == best or outer[i] for i in range(len(page.tag))])
    heading = [page.tag[node] in HEADINGS for node, _, _ in blocks]
    plain_name = [page.factor[node] == page.factor[best] for node, _, _ in blocks]
    kept = [
        c or in_best[node] and p and not (n_link > 0.6 * len(text) and page.tag[node] in ("li", "div", "ul", "td") and not _sentence(text))
        for c, p, (node, text, n_link) in zip(chosen, plain_name, blocks)
    ]
    first, last = kept.index(True), len(kept) - kept[::-1].index(True)
    while first and heading[first - 1]:
        first -= 1
    for i in range(first, last):
        kept[i] = kept[i] or heading[i] and plain_name[i]
    if not any(heading[i] and page.tag[blocks[i][0]] == "h1" for i in range(len(blocks)) if kept[i]):
        titles = [i for i in range(first) if page.tag[blocks[i][0]] == "h1" and plain_name[i]]
        for i in titles[-1:]:  # a title that stands apart from the text
            kept[i] = True
    return "\n".join(text for keep, (_, text, _) in zip(kept, blocks) if keep)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for lo in range(0, batch.num_rows, 64) for x in batch.column("html").slice(lo, 64).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null html counts as empty, whose text is empty. Repeated rows give repeated results, null ids and
    urls pass through, an empty table gives an empty one, and other columns are ignored. A page is
    worked on by itself, so memory is bounded by the longest page.
    """
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    ).mapInArrow(_run, "page_id long, url string, text string, n_chars long")
