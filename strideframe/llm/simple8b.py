"""Simple-8b coding of integers, vectorised with numpy.

A 64-bit word holds a 4-bit selector (high bits) and as many values as fit its width: selector k of
1 to 14 packs COUNTS[k] values of WIDTHS[k] bits, the first value lowest. Selector 15 is an escape: the
word after it is one value of up to 64 bits, as it is. Values are coded in blocks of a fixed count, and
the first word of each block is recorded, so blocks decode on their own.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64], np.int64)
ESCAPE = 15
BLOCK = 512
_BITS = np.concatenate([np.full(1 << max(0, i - 1), i, np.uint8) for i in range(17)])


def _choices(values: np.ndarray, n_blocks: int, block: int) -> np.ndarray:
    """For each position the selector that takes most values from there; the end of a block fits any."""
    if values.max() < 1 << 16:
        bits = _BITS[values.astype(np.int32)]
    else:
        bits = np.zeros(len(values), np.uint8)
        for shift in (48, 32, 16, 0):  # the highest 16 bits that are not zero decide
            part = (values >> np.uint64(shift)).astype(np.uint64) & np.uint64(0xFFFF)
            bits = np.where((bits == 0) & (part != 0), _BITS[part.astype(np.int32)] + np.uint8(shift), bits)
    rows = np.zeros((n_blocks, block + 64), np.uint8)
    flat = np.zeros(n_blocks * block, np.uint8)
    flat[: len(bits)] = bits
    rows[:, :block] = flat.reshape(n_blocks, block)
    widest = {1: rows}
    for p in (1, 2, 4, 8, 16):
        nxt = widest[p].copy()
        nxt[:, :-p] = np.maximum(widest[p][:, :-p], widest[p][:, p:])
        widest[2 * p] = nxt
    choice = np.full((n_blocks, block), ESCAPE, np.uint8)
    for k in range(14, 0, -1):  # narrower selectors take more values, so later ones win
        c, p = int(COUNTS[k]), 1 << (int(COUNTS[k]).bit_length() - 1)
        most = np.maximum(widest[p][:, :block], widest[p][:, c - p : c - p + block])
        choice[most <= np.uint8(WIDTHS[k])] = k
    return choice.reshape(-1)[: len(values)].astype(np.int64)


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned integers."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    n_blocks = -(-n // block)
    index_end = np.minimum(np.arange(1, n_blocks + 1) * block, n)
    choice = _choices(values, n_blocks, block)
    taken = COUNTS[choice]
    at = np.arange(0, n, block)
    limit = index_end.copy()
    taken_to = np.arange(n) + taken
    chosen = np.zeros(n, bool)
    while len(at):
        chosen[at] = True
        at = taken_to[at]
        more = at < limit
        at, limit = at[more], limit[more]
    first = np.flatnonzero(chosen)
    owner = first // block
    kind = choice[first]
    length = np.where(kind == ESCAPE, 2, 1)
    place = np.cumsum(length) - length
    words = np.zeros(int(length.sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(64, np.uint64)])
    stop = index_end[owner]
    for k in np.unique(kind):
        mine = np.flatnonzero(kind == k)
        if k == ESCAPE:
            words[place[mine]] = np.uint64(ESCAPE) << np.uint64(60)
            words[place[mine] + 1] = values[first[mine]]
            continue
        c = int(COUNTS[k])
        at, end = first[mine], stop[mine]
        word = np.full(len(mine), np.uint64(k) << np.uint64(60))
        for i in range(c):
            value = padded[at + i]
            if i:
                value[at + i >= end] = 0
            word |= value << np.uint64(i * int(WIDTHS[k]))
        words[place[mine]] = word
    starts = place[np.searchsorted(owner, np.arange(owner[-1] + 1))]
    return words, starts.astype(np.uint32)


def decode(words: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values of whole blocks."""
    words = np.asarray(words, np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    kind = (words >> np.uint64(60)).astype(np.int64)
    if (kind == ESCAPE).any():  # a raw word may look like an escape: walk along the chain of escapes
        raw = np.zeros(len(words), bool)
        for i in np.flatnonzero(kind == ESCAPE).tolist():
            if not raw[i]:
                raw[i + 1] = True
        kind[raw] = 0
    count = COUNTS[kind]
    block_of = np.searchsorted(starts, np.arange(len(words)), side="right") - 1
    before = np.cumsum(count) - count
    at = before - before[starts][block_of] + block_of * block
    out = np.zeros(max(n, (len(starts)) * block) + 64, np.uint64)
    stop = np.minimum((block_of + 1) * block, n)
    for k in np.unique(kind):
        if not k:
            continue
        mine = np.flatnonzero(kind == k)
        if k == ESCAPE:
            out[at[mine]] = words[mine + 1]
            continue
        c = int(COUNTS[k])
        mask = np.uint64((1 << int(WIDTHS[k])) - 1)
        word, to, end = words[mine], at[mine], stop[mine]
        for i in range(c):
            good = to + i < end
            out[to[good] + i] = (word[good] >> np.uint64(i * int(WIDTHS[k]))) & mask
    return out[:n]
