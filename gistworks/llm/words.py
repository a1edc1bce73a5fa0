"""Words of Arrow text columns as numpy arrays: bounds, 64-bit hashes, hashes of word windows.

Everything works on slices of a few megabytes of text, so that the memory of a
task depends on its longest text and not on its number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes that belong to a word when words are parted by ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing: digits, a-z, all above ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of at most ``limit`` bytes of text, or of one longer row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED):
    """Byte bounds of all words, and the offsets of the rows in them."""
    member = inside[data]
    first = member.copy()
    first[1:] &= ~member[:-1]
    last = member.copy()
    last[:-1] &= ~member[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # words end where rows end
    first[inner] = member[inner]
    last[inner - 1] = member[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at once: what is held beside the text is some dozens of bytes for each of these, not for the whole slice.
HASH_BYTES = 1 << 18

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a usual run of bytes are kept."""
    if n <= HASH_BYTES + 1:
        if not _POWERS:
            _POWERS[:] = _computed(HASH_BYTES + 1)
        return _POWERS[0], _POWERS[1]
    return tuple(_computed(n))


def _computed(n: int) -> list[np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers, out=powers))
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, mixed."""
    out = np.empty(len(starts), np.uint64)
    begin = 0
    while begin < len(starts):
        at = int(starts[begin])
        end = max(begin + 1, int(np.searchsorted(ends, at + HASH_BYTES, "right")))
        part = data[at : int(ends[end - 1])]
        up, down = _powers(len(part) + 1)
        if lower:
            part = LOWER[part]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        a, b = starts[begin:end] - at, ends[begin:end] - at
        out[begin:end] = (sums[b] - sums[a]) * down[a]
        begin = end
    return mix(out)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbours, also of those across rows."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, width, out, done = hashes, 1, None, 0
    while True:  # runs of 1, 2, 4, ... put together as the binary digits of size say
        if size & width:
            part = power[done : done + n]
            out = part if out is None else _pair(out, part)
            done += width
        if done == size:
            return out
        power = _pair(power[:-width], power[width:])
        width *= 2


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows inside rows, whose word offsets are ``rows``, and the offsets of the rows in them."""
    counts = np.maximum(np.diff(rows) - size + 1, 0)
    all_windows = window_hashes(hashes, size)
    at = np.zeros(len(rows), np.int64)
    np.cumsum(counts, out=at[1:])
    picks = np.arange(at[-1]) + np.repeat(rows[:-1] - at[:-1], counts)
    return all_windows[picks], at


def fragments(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range of the hash order, out of ``parts`` equal ones, that each hash lies in."""
    found = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return found.astype(np.uint16 if parts <= 1 << 16 else np.int64)


def pack(hashes: np.ndarray) -> np.ndarray:
    """The low six bytes of each hash; the range it lies in tells most of the rest."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6])


def unpack(packed: np.ndarray) -> np.ndarray:
    """Packed hashes as integers of 48 bits."""
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = packed.reshape(-1, 6)
    return out.view(np.uint64).ravel()


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The binary values of a column, without its nulls, as one array of ``kind``."""
    return np.concatenate([np.empty(0, kind), *[np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid]])


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and lasts of the runs of consecutive integers in a sorted array."""
    breaks = np.flatnonzero(np.diff(values) != 1)
    return values[np.r_[0, breaks + 1]], values[np.r_[breaks, len(values) - 1]]
