"""Personal data in whole texts, with offset-preserving deobfuscation.

Base detectors read the text as it is. For disguised identifiers a transducer rewrites the text:
homoglyphs and full-width forms become ASCII, invisible characters go, spelled digits become digits,
and at/dot disguises become signs. Every output character carries the source range it came from, so
spans found in the rewritten text are mapped back to source characters.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch whose texts are Python strings at a time.
SLICE_ROWS = 256
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[int, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; linear in the length of the text, as each starts from its @."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := DOMAIN.match(text, after)):
            done = after = m.end()
            found.append((start, done))
        elif start == at or after > done:
            # a failed @ ends every later local part
            done = max(done, after)
        at = text.find("@", after)
    return found


def ips(text: str) -> list[tuple[int, int]]:
    """Quads of dotted numbers; a run of digits is entered at its beginning only."""
    found = []
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            quad = parts[i : i + 4]
            end = at + sum(map(len, quad)) + 3
            if all(len(n := x.lstrip("0")) <= 3 and int(n or "0") <= 255 for x in quad):
                found.append((at, end))
            at = end + 1
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]


ANY_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) by start, then kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if ANY_DIGIT.search(text):
        found += [(a, 1, b) for a, b in ips(text)]
        found += [(a, 2, b) for a, b in cards(text)]
        if "+" in text:
            found += [(a, 3, b) for a, b in phones(text)]
    return sorted(found)


# Letters of other scripts that look like ASCII ones, invisible characters, and number words.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    "ı": "i", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "｡": ".", "·": ".", "∙": ".",
}
INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣﻿᠎"
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Spelled digits count only in runs of this many digits, so that prose is left alone.
LEAST_SPELLED = 4


def _forms() -> dict[str, str]:
    """Single characters whose compatibility form or digit value is one printable ASCII character."""
    found = {}
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        if (d := unicodedata.digit(c, None)) is not None and unicodedata.category(c) == "Nd":
            found[c] = str(d)
        elif len(n := unicodedata.normalize("NFKC", c)) == 1 and "!" <= n <= "~":
            found[c] = n
    return found | LOOKALIKES | dict.fromkeys(INVISIBLE, "")


FORMS = _forms()
TABLE = str.maketrans(FORMS)
ODD = frozenset(FORMS)
_WORD = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
SPELLED = re.compile(rf"(?<![^\W_])(?:(?:{_WORD}|[0-9])(?![^\W_])[\x20.,-]{{0,2}}){{{LEAST_SPELLED},}}", re.I)
SPELLED_PART = re.compile(rf"({_WORD}|[0-9])(?:([\x20.,-]{{0,2}}))", re.I)
OPEN, SHUT = r"[\[({<]", r"[\])}>]"
AT = re.compile(rf"\s?{OPEN}\s?(?:at|@|arobase|arroba|ät)\s?{SHUT}\s?", re.I)
DOT = re.compile(rf"\s?{OPEN}\s?(?:dot|\.|point|punkt|punto)\s?{SHUT}\s?", re.I)
SPOKEN_AT = re.compile(r"\s(?:at|@)(?=\s)|@", re.I)
#: What may stand before a spoken at sign, read backwards, and behind it.
SPOKEN_LOCAL = re.compile(r"[A-Za-z0-9_%+-]++(?:(?:\.|\stod\s)[A-Za-z0-9_%+-]++)*+(?!\.)", re.I)
SPOKEN_DOMAIN = re.compile(
    r"(?:(?<=@)|\s)(?!(?:the|a|an|this|that)\s)[A-Za-z0-9-]+(?:(?:\.|\sdot\s)[A-Za-z0-9-]+)*\s(?:dot|punkt|punto)\s[A-Za-z]{2,10}(?![A-Za-z0-9-])", re.I
)
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])\s@\s(?=[A-Za-z0-9-]+\.[A-Za-z]{2,10})")
SPOKEN_DOT = re.compile(r"\s(?:dot|punkt|punto|point)\s", re.I)
SPOKEN_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s(?:dot|punkt|punto|point)\s[0-9]{1,3}){3}(?![0-9.])", re.I)
PLUS = re.compile(r"(?<![^\W_])plus\s(?=\(?[0-9])", re.I)


class Mapped:
    """A text with the source range that each of its characters stands for. Ranges are kept for whole runs:
    those copied from the source, and those that replace a range of it. Memory grows with the edits."""

    def __init__(self, text: str) -> None:
        self.text, self.edited = text, False
        self.begin, self.runs = [0], [(0, len(text), True)]  # place in the text; source range, whether copied

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ranges of the present text; the edits are in order and do not overlap."""
        if not edits:
            return
        text: list[str] = []
        begin: list[int] = []
        runs: list[tuple[int, int, bool]] = []
        ends = [*self.begin[1:], len(self.text)]
        at, size, k = 0, 0, 0

        def copy(a: int, b: int) -> None:
            nonlocal k, size
            text.append(self.text[a:b])
            while a < b:
                while ends[k] <= a:
                    k += 1
                stop = min(b, ends[k])
                x, y, copied = self.runs[k]
                begin.append(size)
                runs.append((x + a - self.begin[k], x + stop - self.begin[k], True) if copied else (x, y, False))
                size += stop - a
                a = stop

        for a, b, new in edits:
            copy(at, a)
            if new:
                text.append(new)
                begin.append(size)
                runs.append((*self.source(a, b), False))
                size += len(new)
            at = b
        copy(at, len(self.text))
        self.text, self.begin, self.runs, self.edited = "".join(text), begin or [0], runs or [(0, 0, True)], True

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source range of the characters from ``a`` to before ``b``."""
        i, j = bisect_right(self.begin, a) - 1, bisect_right(self.begin, b - 1) - 1
        x, _, copied = self.runs[i]
        _, y, last_copied = self.runs[j]
        return x + a - self.begin[i] if copied else x, self.runs[j][0] + b - self.begin[j] if last_copied else y


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in SPELLED.finditer(text):
        if sum(1 for p in SPELLED_PART.finditer(m[0]) if not p[1].isdigit()) < LEAST_SPELLED:
            continue
        parts = list(SPELLED_PART.finditer(m[0]))
        for i, p in enumerate(parts):
            digit = NUMBER_WORDS.get(p[1].lower(), p[1])
            last = i == len(parts) - 1
            stop = m.start() + (p.end(1) if last else p.end())
            edits.append((m.start() + p.start(), stop, digit))
    return edits


def _signs(text: str) -> list[tuple[int, int, str]]:
    edits = [(m.start(), m.end(), "@") for m in AT.finditer(text)] + [(m.start(), m.end(), ".") for m in DOT.finditer(text)]
    return sorted(edits)


def _spoken(text: str) -> list[tuple[int, int, str]]:
    """Edits of addresses whose signs are spoken. Each at sign is looked at once: what stands before it ends
    at the at sign before, and what stands behind it at the next, so the scan is linear."""
    edits = []
    done, backwards = 0, None
    for sign in SPOKEN_AT.finditer(text):
        if sign.start() < done or not (domain := SPOKEN_DOMAIN.match(text, sign.end())):
            continue
        backwards = backwards or text[::-1]
        local = SPOKEN_LOCAL.match(backwards, len(text) - sign.start(), len(text) - done)
        if not local:
            continue
        start, done = len(text) - local.end(), domain.end()
        width = sign.end() - sign.start()
        edits.append((sign.start(), sign.end() + (width > 1), "@"))
        edits += [(m.start(), m.end(), ".") for m in SPOKEN_DOT.finditer(text, start, sign.start())]
        edits += [(m.start(), m.end(), ".") for m in SPOKEN_DOT.finditer(text, sign.end(), done)]
    for m in SPOKEN_IP.finditer(text):
        edits += [(s.start(), s.end(), ".") for s in SPOKEN_DOT.finditer(text, m.start(), m.end())]
    edits += [(m.start(), m.end(), "@") for m in SPACED_AT.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for e in sorted(edits):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


BRACKET = re.compile(rf"{OPEN}\s?(?:at|@|arobase|arroba|ät|dot|\.|point|punkt|punto)\s?{SHUT}", re.I)
SPOKEN_HINTS = (" dot ", " punkt ", " punto ", " point ", " @ ")


#: Characters of a text whose words are listed at a time, and by how many two such parts overlap.
PART, OVERLAP = 1 << 20, 256


def _may_spell(low: str) -> bool:
    """Whether LEAST_SPELLED number words stand close together; reads each word once."""
    for lo in range(0, len(low), PART):
        words = low[lo : lo + PART + OVERLAP].replace(".", " ").replace(",", " ").replace("-", " ").split()
        at = [i for i, w in enumerate(words) if w in NUMBER_WORDS]
        if any(b - a < 3 * LEAST_SPELLED for a, b in zip(at, at[LEAST_SPELLED - 1 :])):
            return True
    return False


def _may_speak(low: str) -> bool:
    spaced = low.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    return any(x in spaced for x in SPOKEN_HINTS)


def deobfuscated(text: str) -> Mapped | None:
    """The rewritten text, or None if no disguise is found."""
    odd = set() if text.isascii() else ODD.intersection(text)
    first = text.translate(TABLE) if odd else text
    low = first.lower()
    spelled = _may_spell(low)
    if not (odd or spelled or BRACKET.search(first) or _may_speak(low)):
        return None
    out = Mapped(text)
    if odd:
        here = re.compile("[" + "".join(map(re.escape, sorted(odd))) + "]")
        out.replace([(m.start(), m.end(), FORMS[m[0]]) for m in here.finditer(text)])
    if spelled:
        out.replace(_spelled(out.text))
    out.replace(_signs(out.text))
    out.replace(_spoken(out.text))
    out.replace([(m.start(), m.end(), "+") for m in PLUS.finditer(out.text)])
    return out if out.edited else None


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, base and disguised spans), each by start, then kind.

    A disguised span is left out only where a base span of its kind covers it: a base span is often a
    fragment of the disguised identifier.
    """
    base = base_spans(text)
    out = deobfuscated(text)
    if out is None:
        return base, base
    more = []
    for a, kind, b in base_spans(out.text):
        s, e = out.source(a, b)
        if text[s:e] != out.text[a:b] and not any(k == kind and x <= s and e <= y for x, k, y in base):
            more.append((s, kind, e))
    return base, sorted({*base, *more})


def spelled_out(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long, n_spans long"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in (b.slice(lo, SLICE_ROWS) for b in batches for lo in range(0, b.num_rows, SLICE_ROWS)):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            base, every = all_spans(text)
            counts = [sum(1 for x in base if x[1] == k) for k in range(4)]
            rows.append((doc_id, *counts, hashlib.sha256(spelled_out(base).encode()).hexdigest(), spelled_out(every), len(every) - len(base), len(every)))
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        kinds = [pa.string() if n in ("base_sha256", "spans") else pa.int64() for n in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts of base spans by kind, base_sha256, spans, n_disguised (spans
    that the method adds), n_spans. The work on a text is linear in its length.

    Null texts count as empty and have no spans. Rows are worked on each by itself: repeated rows repeat
    their result, null ids pass through, an empty table gives an empty one, other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_run, SCHEMA)


def redact(text: str, mask: str = "[{}]") -> str:
    """The text with every span, disguised ones too, replaced by its kind; overlapping spans go as one, named for the longest."""
    out, at = [], 0
    merged: list[tuple[int, int, int, int]] = []
    for a, k, b in all_spans(text)[1]:
        if merged and a < merged[-1][2]:
            start, kind, end, longest = merged[-1]
            merged[-1] = (start, k if b - a > longest else kind, max(end, b), max(longest, b - a))
        else:
            merged.append((a, k, b, b - a))
    for a, k, b, _ in merged:
        out += [text[at:a], mask.format(KINDS[k].upper())]
        at = b
    return "".join([*out, text[at:]])
