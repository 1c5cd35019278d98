"""Whole-text encoding with the tokenizers library, through a bounded cache of words.

The library encodes every distinct word; a text is put together from its words' ids. A text is cut
only at a single space or newline between two characters that are not white space, where the
vocabularies' own splitting always cuts, so the ids equal those of the whole text. A text with any
other white space at a cut is encoded whole, and so is a text with the string of an added token, which
the library recognises in text.
"""

from __future__ import annotations

import gc
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import trim

#: Words kept by a Python worker while it works on a task, and from one task to the next; beyond it the cache starts anew.
CACHE_WORDS, LASTING_WORDS = 700_000, 150_000
TAIL = ".,;:!?"
END_ID = 2

_cached: dict[str, WordEncoder] = {}


def encoder(name: str, path: str | None = None) -> WordEncoder:
    """The worker's encoder of the named vocabulary file; ``path`` overrides where it lies."""
    if (key := path or name) not in _cached:
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _cached[key] = WordEncoder(path)
    return _cached[key]


class WordEncoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        vocab = self.lib.get_vocab()
        self.lower = "the</w>" in vocab
        added = [x.content for x in self.lib.get_added_tokens_decoder().values()]
        self.added = [x.lower() if self.lower else x for x in added]
        width = max(vocab.values()) + 1
        self.n_bytes, self.ends = np.zeros(width, np.int64), np.zeros(width, bool)
        for word, i in vocab.items():
            self.n_bytes[i], self.ends[i] = len(word), word.endswith("</w>")
        self.most_words = CACHE_WORDS
        self.clear()

    def clear(self) -> None:
        #: piece -> row of core_of and tail_of, which name entries; entry 0 is empty
        self.words: dict[str, int] = {}
        self.entries: dict[str, int] = {"": 0}
        self.core_of, self.tail_of = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32)
        self.start, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0

    def release(self) -> None:
        """Call at the end of a task: workers live on and serve other stages."""
        if len(self.words) > LASTING_WORDS:
            self.clear()
        trim()

    def _spaced(self, text: str) -> str | None:
        """The text with a space at each cut; None: it is encoded whole."""
        if self.lower:
            if "Σ" in text or "\1" in text:
                return None
            low = text.lower()
            return None if self._has_added(low) else low.replace("\n", " ")
        return None if "\0" in text or "\1" in text or self._has_added(text) else "\0" + text.replace("\n", " \n")

    def _split(self, spaced: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different pieces of all texts, the one that stands at each place, and the places where texts begin and end.
        Arrow finds what is different, so that a piece is looked up once a call and not wherever it stands."""
        split = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        places, bounds = split.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy())])
        if self.lower:  # there an empty piece stands for nothing
            full = pc.binary_length(places).to_numpy() > 0
            places, bounds = places.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[bounds]
        found = pc.dictionary_encode(places)
        return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), bounds

    def _has_added(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def _safe(self, piece: str) -> bool:
        """Whether the cuts on both sides of a piece are where the vocabulary cuts too."""
        core = piece[1:] if piece[:1] in ("\0", "\n") else piece
        return bool(core) and not core[0].isspace() and not core[-1].isspace()

    def _add(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.entries), len(keys)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + m] = sizes
        self.used += len(ids)
        self.entries.update(zip(keys, range(n, n + m)))

    def _add_each(self, keys: list[str], texts: list[str]) -> None:
        for i in range(0, len(keys), 2000):
            got = [x.ids for x in self.lib.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)]
            self._add(keys[i : i + 2000], np.array(list(chain.from_iterable(got)), np.uint32), np.array([len(x) for x in got], np.int64))

    def _add_cores(self, keys: list[str], cores: list[str], before: str) -> None:
        """Words of letters, ``before`` stands in front of each; many words a call of the library."""
        for i in range(0, len(cores), 2000):
            part, key = cores[i : i + 2000], keys[i : i + 2000]
            flat = np.array(self.lib.encode_batch_fast([before + before.join(part)], add_special_tokens=False)[0].ids, np.int64)
            if self.lower:
                ends = np.flatnonzero(self.ends[flat]) + 1
                right = len(ends) == len(part) and ends[-1] == len(flat)
            else:
                at = np.cumsum(self.n_bytes[flat])
                marks = np.cumsum([1 + len(x.encode()) for x in part])
                ends = np.searchsorted(at, marks) + 1
                right = ends[-1] == len(flat) and bool((at[ends - 1] == marks).all())
            if right:
                self._add(key, flat, np.diff(ends, prepend=0))
            else:
                self._add_each(key, [("" if self.lower else before) + x for x in part])

    def _learn(self, new: list[str]) -> set[str]:
        """Adds pieces to the cache; returns those at whose cuts the vocabulary may not cut.
        Trailing points and commas are words of their own in either vocabulary."""
        unsafe: set[str] = set()
        plain: dict[str, None] = {}
        lines: dict[str, None] = {}
        raw: dict[str, str] = {}
        kept, keys, tails = [], [], []
        entries = self.entries
        for piece in new:
            if piece.isalpha():  # most of them
                if piece not in entries:
                    plain[piece] = None
                kept.append(piece)
                keys.append(piece)
                tails.append("")
                continue
            if not piece:
                unsafe.add(piece)
                continue
            core = piece.rstrip(TAIL)
            if core.isalpha():
                key, tail = core, piece[len(core) :]
                if key not in entries:
                    plain[key] = None
            elif piece[0] == "\n" and core[1:].isalpha():
                key, tail = core, piece[len(core) :]
                if key not in entries:
                    lines[key] = None
            else:
                if not self.lower and not self._safe(piece):
                    unsafe.add(piece)
                    continue
                key, tail = "\1" + piece, ""
                if key not in entries:
                    raw[key] = piece if self.lower or piece[0] == "\n" else piece[1:] if piece[0] == "\0" else " " + piece
            if tail and tail not in entries:
                raw[tail] = tail
            kept.append(piece)
            keys.append(key)
            tails.append(tail)
        if plain:
            self._add_cores(list(plain), list(plain), " ")
        if lines:
            self._add_cores(list(lines), [x[1:] for x in lines], "\n")
        if raw:
            self._add_each(list(raw), list(raw.values()))
        n, m = len(self.words), len(kept)
        while n + m > len(self.core_of):
            self.core_of, self.tail_of = (np.concatenate([x, np.zeros_like(x)]) for x in (self.core_of, self.tail_of))
        self.core_of[n : n + m] = np.fromiter(map(entries.__getitem__, keys), np.int32, m)
        self.tail_of[n : n + m] = np.fromiter(map(entries.__getitem__, tails), np.int32, m)
        self.words.update(zip(kept, range(n, n + m)))
        return unsafe

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers. Nothing made here forms a cycle, so the collector rests meanwhile."""
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > self.most_words:
            self.clear()
        spaced = [self._spaced(x) for x in texts]
        while True:
            pieces, which, bounds = self._split(spaced)
            row = np.fromiter(map(self.words.get, pieces, repeat(-1)), np.int64, len(pieces))
            if not len(missed := np.flatnonzero(row < 0)):
                break
            missed_pieces = [pieces[i] for i in missed.tolist()]
            bad = self._learn(missed_pieces)
            if not bad:
                row[missed] = np.fromiter(map(self.words.__getitem__, missed_pieces), np.int64, len(missed))
                break
            at_bad = np.concatenate([[0], np.cumsum(np.fromiter(map(bad.__contains__, pieces), bool, len(pieces))[which])])
            spaced = [None if n else s for s, n in zip(spaced, (at_bad[bounds[1:]] - at_bad[bounds[:-1]]).tolist())]
        rest = {
            i: np.array(self.lib.encode_batch_fast([texts[i]], add_special_tokens=False)[0].ids, np.uint32)
            for i, s in enumerate(spaced) if s is None
        }
        at = row[which]
        both = np.empty(2 * len(at), np.int64)
        both[::2], both[1::2] = self.core_of[at], self.tail_of[at]
        size = self.size[both].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.start[both] - total[:-1], size) + np.arange(total[-1])]
        stops = total[2 * bounds]
        return [rest[i] if i in rest else flat[stops[i] : stops[i + 1]] for i in range(len(texts))]
