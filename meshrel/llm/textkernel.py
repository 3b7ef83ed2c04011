"""Vectorised byte and word kernels that the Arrow stages of this subpackage share.

All functions work on one *slice*: the concatenated UTF-8 bytes of some rows and their
row offsets. Slices are bounded in bytes, so memory does not follow the Arrow batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
LONGEST = 64

_rng = np.random.default_rng(20240611)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply) that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next call."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, end row, bytes, offsets) of at most ``most`` bytes, or of one row; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-space bytes, and each row's offsets into them."""
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & (~before | cut[:-1]))
        after = np.empty(len(data), bool)
        after[-1] = False
        after[:-1] = solid[1:]
        ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the given disjoint non-empty ascending byte spans.

    Polynomials modulo a power of two collide on long structured texts, so spans over ``LONGEST`` bytes are hashed by BLAKE2b.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    long = np.flatnonzero(size > LONGEST)
    if len(long):
        out = np.empty(len(size), np.uint64)
        raw = [blake2b(data[a:b].tobytes(), digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        out[long] = np.frombuffer(b"".join(raw), np.uint64)
        plain = np.flatnonzero(size <= LONGEST)
        out[plain] = span_hashes(data, starts[plain], ends[plain])
        return out
    total = int(size.sum())
    first = np.zeros(len(size), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    inside = np.arange(total) - np.repeat(first, size)
    at = inside + np.repeat(starts, size)
    terms = BYTE_VALUES[data[at]] * powers(int(size.max()))[inside]
    return mix(np.add.reduceat(terms, first) + size.astype(np.uint64))


def shingle_hashes(words: np.ndarray, word_off: np.ndarray, k: int, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of each row (repeats kept), and each row's offsets into them.

    A row with 1 to k - 1 words has its whole sequence as its only shingle if ``short_whole``.
    """
    count = np.diff(word_off)
    full = np.maximum(count - k + 1, 0)
    short = (count > 0) & (count < k) if short_whole else np.zeros(len(count), bool)
    out_off = np.zeros(len(count) + 1, np.int64)
    np.cumsum(full + short, out=out_off[1:])
    out = np.zeros(out_off[-1], np.uint64)
    inside = np.arange(out_off[-1]) - np.repeat(out_off[:-1], full + short)
    first = inside + np.repeat(word_off[:-1], full + short)
    is_full = np.repeat(full > 0, full + short)
    at = first[is_full]
    value = np.full(len(at), 0x51ED27, np.uint64)
    for j in range(k):
        value = mix(value * np.uint64(0xD1342543DE82EF95) + words[at + j])
    out[is_full] = value
    for row in np.flatnonzero(short):
        value = np.full(1, 0x7A0F13, np.uint64)
        for w in words[word_off[row] : word_off[row + 1]]:
            value = mix(value * np.uint64(0xD1342543DE82EF95) + w)
        out[out_off[row]] = value[0]
    return out, out_off


def distinct_sorted(values: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct values of each row."""
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
        part = np.sort(values[lo:hi])
        if len(part) > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        yield part


def texts_of(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``text_slices`` with A-Z lower-cased if ``lower``."""
    for lo, hi, data, off in text_slices(column):
        yield lo, hi, LOWER[data] if lower else data, off
