"""Vectorised tokenising of Arrow string columns.

All separators of the word rules used here are ASCII, so words are found on
the UTF-8 bytes of a column without decoding it.  A word becomes a 64-bit hash;
texts become slices of one flat array of word hashes.  Work goes over blocks of
rows of a bounded number of bytes (a longer text is a block of its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_GRAM = 0xD6E8FEB86659FD93


def _tables():
    byte = np.arange(256)
    space = np.ones(256, bool)
    space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    lower = byte.astype(np.uint8)
    lower[65:91] += 32
    alnum = (byte >= 0x80) | ((byte >= 0x30) & (byte <= 0x39)) | ((byte >= 0x61) & (byte <= 0x7A))
    return space, alnum, lower


#: bytes inside words of ``[^\x20\x09-\x0D]+`` / of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
SPACE_WORDS, ALNUM_WORDS, LOWER = _tables()

_POWERS: dict = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n (kept and grown per process)."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, _U(base))
        have[0] = _U(1)
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply), a bijection."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES):
    """(first row, end row) of runs of rows of at most ``limit`` bytes, one
    row at least."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Words of a block of texts: ``hash`` per word, ``off`` (row -> range of
    words), byte ``start`` and ``end`` of each word in ``data``."""

    def __init__(self, data: np.ndarray, off: np.ndarray, inside: np.ndarray, lower: bool = False):
        if lower:
            data = LOWER[data]
        n = len(data)
        self.data, self.rows = data, len(off) - 1
        is_word = inside[data]
        before = np.zeros(n, bool)
        before[1:] = is_word[:-1]
        cut = off[:-1][off[:-1] < n]
        before[cut] = False
        self.start = np.flatnonzero(is_word & ~before)
        after = np.zeros(n, bool)
        after[:-1] = is_word[1:]
        after[cut[cut > 0] - 1] = False
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.off = np.searchsorted(self.start, off)
        if len(self.start):
            terms = (data.astype(np.uint64) + _U(1)) * powers(_BASE, n)
            terms[~is_word] = 0
            sums = np.add.reduceat(terms, self.start)
            self.hash = mix(sums * powers(pow(_BASE, -1, 1 << 64), n)[self.start])
        else:
            self.hash = np.zeros(0, np.uint64)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.off)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]: self.end[i]].tobytes()


def batch_words(col: pa.Array, inside: np.ndarray, lower: bool = False, limit: int = BLOCK_BYTES):
    """Yield (first row, end row, Words) over blocks of a column."""
    data, off = column_bytes(col)
    for lo, hi in blocks(off, limit):
        part = off[lo: hi + 1]
        yield lo, hi, Words(data[part[0]: part[-1]], part - part[0], inside, lower)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (len(h) - k + 1 of them)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have, block, size, left = None, 0, h, 1, k
    while left:  # binary decomposition of k: join hashes of neighbouring runs
        if left & 1:
            if out is None:
                out, have = block, size
            else:
                n = len(h) - (have + size) + 1
                out = out[:n] * _U(pow(_GRAM, size, 1 << 64)) + block[have: have + n]
                have += size
        left >>= 1
        if left:
            n = len(h) - 2 * size + 1
            block = block[:n] * _U(pow(_GRAM, size, 1 << 64)) + block[size: size + n]
            size *= 2
    return mix(out[: len(h) - k + 1])


def range_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the word sequences [lo, hi), of any lengths."""
    n = len(h) + 1
    total = np.zeros(n, np.uint64)
    np.cumsum(h * powers(_GRAM, n)[:-1], out=total[1:])
    inverse = powers(pow(_GRAM, -1, 1 << 64), n)
    return mix((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * _U(_BASE))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-word shingle hashes of each row, flat, with row offsets; a row of
    fewer words (but some) has its whole sequence as one shingle."""
    n = w.count
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(off[-1]) - np.repeat(off[:-1], size) + np.repeat(w.off[:-1], size)
    g = grams(w.hash, k)
    out = g[np.minimum(at, max(len(g) - 1, 0))] if len(g) else np.zeros(off[-1], np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        out[off[short]] = range_hash(w.hash, w.off[short], w.off[short + 1])
    return out, off
