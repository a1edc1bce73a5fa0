"""Simple-8b word-aligned coding of integers (Anh and Moffat, 2010) with numpy.

Four bits of a 64-bit word select how many integers of which width its other
sixty bits hold, always as many as fit. An integer beyond sixty bits escapes:
selector 0, then the integer in a word of its own. Integers are coded in blocks
that start at a fresh word, so that all blocks are coded, and decoded, at once;
the last word of a block is filled up with zeros, which its size tells.
"""

from __future__ import annotations

import numpy as np

#: Integers of a block.
BLOCK = 512

#: Fixed values of the format: integers per word and bits of each, by selector from 1.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // c for c in COUNTS)

_PER_WORD = np.array([1, *COUNTS, 0], np.int64)
_U64 = np.uint64
_PAD = COUNTS[0]


_SMALL = np.array([max(1, n.bit_length()) for n in range(256)], np.uint8)
_SMALL = np.concatenate([_SMALL, np.repeat(_SMALL[1:] + 8, 256)])  # of every 16-bit integer


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each integer; 1 for zero."""
    if int(ids.max()) < 1 << 16:
        return _SMALL[ids]
    bits = np.ones(ids.shape, np.uint8)
    for power in range(1, 64):
        bits += ids >> _U64(power) != 0
    return bits


def _selectors(ids: np.ndarray) -> np.ndarray:
    """The selector of a word that would begin at each place of a block (one block a row, zeros behind its end)."""
    bits = _widths(ids)
    columns = np.arange(ids.shape[1], dtype=np.int16)
    chosen = np.zeros(ids.shape, np.uint8)  # the escape
    for selector in range(len(COUNTS), 0, -1):
        wide = bits > WIDTHS[selector - 1]
        if COUNTS[selector - 1] > 1:
            breaks = np.flatnonzero(wide[:, : wide.shape[1] - _PAD])
            if len(breaks) and np.diff(breaks).max(initial=0) <= COUNTS[selector - 1]:
                break  # no run of that many, and none of more
        end = np.where(wide, columns, np.int16(32767))
        end = np.minimum.accumulate(end[:, ::-1], axis=1)[:, ::-1]
        chosen[end - columns >= COUNTS[selector - 1]] = selector
    return chosen


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """``(words, offsets)``: the words of all blocks and where each block's begin (and the last one's end)."""
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.empty(0, _U64), np.zeros(1, np.int64)
    wide = block + _PAD
    rows = np.zeros((blocks, wide), _U64)
    flat = np.zeros(blocks * block, _U64)
    flat[:n] = ids
    rows[:, :block] = flat.reshape(blocks, block)
    sizes = np.full(blocks, block, np.int64)
    sizes[-1] = n - (blocks - 1) * block
    chosen = _selectors(rows)
    steps = _PER_WORD[chosen].astype(np.int16)
    begins = np.zeros(rows.shape, bool)
    lane, at = np.arange(blocks), np.zeros(blocks, np.int64)
    while len(lane):
        begins[lane, at] = True
        at = at + steps[lane, at]
        going = at < sizes[lane]
        lane, at = lane[going], at[going]
    places = np.flatnonzero(begins)
    selectors = chosen.ravel()[places]
    length = np.where(selectors == 0, 2, 1)
    ends = np.cumsum(length)
    words = np.zeros(int(ends[-1]), _U64)
    values = rows.ravel()
    for selector in np.unique(selectors):
        own = np.flatnonzero(selectors == selector)
        if selector == 0:
            words[ends[own] - 1] = values[places[own]]
            continue
        count, width = COUNTS[selector - 1], WIDTHS[selector - 1]
        word = np.full(len(own), _U64(int(selector) << 60))
        for k in range(count):
            word |= values[places[own] + k] << _U64(k * width)
        words[ends[own] - 1] = word
    first = np.searchsorted(places, np.arange(blocks) * wide)
    return words, np.r_[ends[first] - length[first], ends[-1]]


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` integers of ``encode``'s words, all blocks at once."""
    if not n:
        return np.empty(0, _U64)
    selectors = (words >> _U64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    for at in np.flatnonzero(selectors == 0).tolist():  # few: an escape's second word may look like anything
        if not raw[at]:
            raw[at + 1] = True
    head = np.flatnonzero(~raw)
    selectors = selectors[head]
    counts = _PER_WORD[selectors]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]), _U64)
    for selector in np.unique(selectors):
        own = np.flatnonzero(selectors == selector)
        if selector == 0:
            out[ends[own] - 1] = words[head[own] + 1]
            continue
        count, width = COUNTS[selector - 1], WIDTHS[selector - 1]
        base, mask, word = ends[own] - count, _U64((1 << width) - 1), words[head[own]]
        for k in range(count):
            out[base + k] = word >> _U64(k * width) & mask
    blocks = len(offsets) - 1
    first = np.searchsorted(head, offsets[:-1])
    begin = ends[first] - counts[first]
    sizes = np.full(blocks, block, np.int64)
    sizes[-1] = n - (blocks - 1) * block
    return out[np.repeat(begin - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(n)]
