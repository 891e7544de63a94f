"""Simple-8b word-aligned integer coding, vectorised with numpy.

A 64-bit word has a 4-bit selector on top and 60 bits of payload. The ids of a block are
packed greedily, the largest count that fits first. Blocks hold ``BLOCK`` ids and start at
a stored word offset, so any block is decoded alone and all words of a block at once.
Ids of 2**60 and more are escapes: selector 0 holds the low 60 bits of one id and a side
list holds the high 4 bits, in order, so no word has to be parsed before another.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024

# selector -> (ids in the word, bits an id). Fixed values of the format.
# 0 is the escape (one id, low 60 bits), 1 a run of 120 zeros.
SELECTORS = (
    (1, 60), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
_COUNT = np.array([c for c, _ in SELECTORS], dtype=np.int64)
_PAD = 120


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits needed by each id; 0 for 0. Read off the exponent of a double, in halves so that none is rounded."""
    high = ids >> np.uint64(32)
    low = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1].astype(np.uint8)
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1].astype(np.uint8) + np.uint8(32), low) if high.any() else low


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words uint64, word offset of each block, high bits of escapes as uint8)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint8)
    width = BLOCK + _PAD
    values = np.zeros((blocks, width), dtype=np.uint64)
    bits = np.full((blocks, width), 255, dtype=np.uint8)
    flat = np.zeros(blocks * BLOCK, dtype=np.uint64)
    flat[:n] = ids
    values[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    lengths = np.full(blocks * BLOCK, 255, dtype=np.uint8)
    lengths[:n] = _bit_lengths(ids)
    bits[:, :BLOCK] = lengths.reshape(blocks, BLOCK)

    # best[i]: selector for a word that starts at i. windows[p]: maximum over p ids from i.
    windows = {1: bits}
    p = 1
    while p * 2 <= 64:
        w = windows[p].copy()
        w[:, :-p] = np.maximum(w[:, :-p], windows[p][:, p:])
        w[:, -p:] = 255
        windows[p * 2] = w
        p *= 2
    best = np.zeros((blocks, BLOCK), dtype=np.uint8)  # the escape, if nothing else fits
    for s in range(15, 0, -1):
        count, b = SELECTORS[s]
        p = 1 << (count.bit_length() - 1)
        w = windows[p]
        if w.min() <= b:
            top = np.maximum(w[:, :BLOCK], w[:, count - p : count - p + BLOCK])
            np.putmask(best, top <= b, s)

    # all blocks advance together, a word each in every step
    pos = np.zeros(blocks, dtype=np.int64)
    ends = np.full(blocks, BLOCK, dtype=np.int64)
    ends[-1] = n - (blocks - 1) * BLOCK
    rows = np.arange(blocks)
    seen_row, seen_pos, seen_sel = [], [], []
    while len(rows):
        sel = best[rows, pos[rows]]
        seen_row.append(rows)
        seen_pos.append(pos[rows])
        seen_sel.append(sel)
        pos[rows] += _COUNT[sel]
        rows = rows[pos[rows] < ends[rows]]
    row, at, sel = map(np.concatenate, (seen_row, seen_pos, seen_sel))
    order = np.argsort(row, kind="stable")
    row, at, sel = row[order], at[order], sel[order]
    offsets = np.zeros(blocks + 1, dtype=np.int64)
    np.cumsum(np.bincount(row, minlength=blocks), out=offsets[1:])

    words = sel.astype(np.uint64) << np.uint64(60)
    start = row * width + at
    stream = values.reshape(-1)
    low = np.uint64((1 << 60) - 1)
    for s, (count, b) in enumerate(SELECTORS):
        here = np.flatnonzero(sel == s)
        if not len(here) or b == 0:
            continue
        picked = stream[start[here][:, None] + np.arange(count)]
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(b)
        words[here] |= np.bitwise_or.reduce((picked & low) << shifts, axis=1)
    high = (stream[start[sel == 0]] >> np.uint64(60)).astype(np.uint8)
    return words, offsets, high


def decode(words: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Ids of whole blocks from their words and the high bits of their escapes."""
    words = np.asarray(words, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNT[sel]
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    for s, (c, b) in enumerate(SELECTORS):
        here = np.flatnonzero(sel == s)
        if not len(here) or b == 0:
            continue
        shifts = np.arange(c, dtype=np.uint64) * np.uint64(b)
        mask = np.uint64((1 << b) - 1)
        out[start[here][:, None] + np.arange(c)] = (words[here][:, None] >> shifts) & mask
    here = np.flatnonzero(sel == 0)
    if len(here):
        out[start[here]] |= np.asarray(high, dtype=np.uint64) << np.uint64(60)
    return out
