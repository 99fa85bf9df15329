"""Word hashes of whole Arrow batches with numpy.

Every function works on bytes in pieces of about a megabyte, so memory follows the largest document,
not the batch. A word is a run of bytes of a table; its hash is a polynomial over random byte values
modulo 2^64, mixed afterwards, so different words share a hash with odds of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20


def byte_table(separators: set[int]) -> np.ndarray:
    """True for the bytes that belong to words."""
    return np.array([b not in separators for b in range(256)])


#: Words between white space.
SPACED = byte_table({0x20, *range(0x09, 0x0E)})
#: Words of ASCII letters and digits and of all other characters beyond ASCII.
ALNUM = byte_table({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})

_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_VALUES[65:91] = _VALUES[97:123]      # A-Z count as a-z
_POWERS = np.multiply.accumulate(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole word."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.multiply.accumulate(np.full(2 * n, 0x9E3779B97F4A7C15, dtype=np.uint64))
    return _POWERS


def word_spans(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words in `buf`."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], table[buf], [False])).view(np.int8)))
    return edges[0::2], edges[1::2]


def hash_words(buf: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and 64-bit hashes of the words in `buf`; A-Z are folded."""
    starts, ends = word_spans(buf, table)
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    offset = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = _VALUES[buf[table[buf]]]
    sums = np.add.reduceat(values * _powers(int(sizes.max()))[offset], first)
    return starts, mix(sums + sizes.astype(np.uint64))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)), offsets


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, start of each row) with one space after every row."""
    data, offsets = buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        size = int(offsets[hi] - offsets[lo])
        buf = np.full(size + hi - lo, 0x20, dtype=np.uint8)
        starts = offsets[lo:hi] - offsets[lo] + np.arange(hi - lo)
        for k in range(hi - lo):
            a, b = int(offsets[lo + k]), int(offsets[lo + k + 1])
            buf[int(starts[k]):int(starts[k]) + b - a] = data[a:b]
        yield lo, hi, buf, starts
        lo = hi


def row_words(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, words of each row, word hashes of all rows)."""
    for lo, hi, buf, starts in pieces(column):
        if hi - lo == 1 and len(buf) > 4 * PIECE:       # one very long row: cut between words
            parts, at = [], 0
            separators = np.flatnonzero(~table[buf])
            while at < len(buf):
                k = int(np.searchsorted(separators, at + PIECE))
                end = int(separators[k]) + 1 if k < len(separators) else len(buf)
                parts.append(hash_words(buf[at:end], table)[1])
                at = end
            hashes = np.concatenate(parts)
            yield lo, hi, np.array([len(hashes)]), hashes
            continue
        at, hashes = hash_words(buf, table)
        row = np.searchsorted(starts, at, "right") - 1
        yield lo, hi, np.bincount(row, minlength=hi - lo), hashes


_STEPS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)


def shingles(counts: np.ndarray, hashes: np.ndarray, width: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words of each row, in order, and how many each row has.

    With `whole_if_short` a row of fewer words, but not none, has its whole sequence as the only one.
    """
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.maximum(counts - width + 1, 0)
    total = int(n.sum())
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(total)
    out = np.zeros(total, dtype=np.uint64)
    for k in range(width):
        out += hashes[at + k] * _STEPS[k]
    out = mix(out)
    short = np.flatnonzero((counts > 0) & (counts < width)) if whole_if_short else []
    if len(short):
        values = []
        for r in short:
            w = hashes[starts[r]:ends[r]]
            values.append(mix(np.array([(w * _STEPS[:len(w)]).sum() + U(len(w))], dtype=np.uint64))[0])
        out = np.insert(out, (np.cumsum(n) - n)[short], np.array(values, dtype=np.uint64))
        n = n.copy()
        n[short] = 1
    return n, out
