"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def exact_groups(docs):
    """{doc_id: (keep_id, size, sha)} of (doc_id, text) rows with different ids."""
    groups = defaultdict(list)
    for i, text in docs:
        groups[BLANK.sub("", text or "")].append((-len(text or ""), i))
    return {i: (min(g)[1], len(g), sha(norm)) for norm, g in groups.items() for _, i in g}


WEIGHTS = {"log": int.bit_length, "count": int, "binary": lambda c: 1}


def near_classes(docs, threshold=0.8, width=5, weighting="log"):
    """{doc_id: class id}: components over all pairs of weighted shingle sets."""
    sets = {}
    for i, text in docs:
        w = words(text)
        counts = Counter(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else None
        sets[i] = frozenset((x, j) for x, c in counts.items() for j in range(WEIGHTS[weighting](c))) if w else None
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(set)
    for i, s in sets.items():
        for x in s or ():
            by[x].add(i)
    for i, s in sets.items():
        met = Counter(j for x in s or () for j in by[x] if j > i)
        for j, n in met.items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def contaminated(docs, items, n=13):
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[k : k + n])].add(i)
    lengths = {len(k) for k in windows}
    out = {}
    for i, text in docs:
        w, hit, met = words(text), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if (found := windows.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    met |= found
        out[i] = (len(w), len(hit), len(met), sha(",".join(sorted(map(str, met)))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def repeats(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha of what is kept)}."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda x: x[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(raw), sum(gone), runs, sha(bytes(b for b, g in zip(raw, gone) if not g)))
    return out
