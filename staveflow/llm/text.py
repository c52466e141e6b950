"""Vectorised byte and word kernels over Arrow string columns.

All kernels work on UTF-8 bytes, so a text is never cut: a chunk holds whole
documents, and one document longer than the chunk size is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 18
_ROOT = 0x9E3779B97F4A7C15
_ROOT_INVERSE = pow(_ROOT, -1, 1 << 64)

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words split by white space: everything but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of digits, letters and all that is not ASCII (after lower-casing).
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True

#: Bytes of words of letters and all that is not ASCII (after lower-casing).
LETTER_BYTE = WORD_BYTE.copy()
LETTER_BYTE[0x30:0x3A] = False

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to a chunk's length."""
    kept = _powers.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    table = np.full(max(n, min(2 * n, CHUNK_BYTES + 65)), base, dtype=U64)
    table[0] = 1
    np.multiply.accumulate(table, out=table)
    if len(table) <= 2 * CHUNK_BYTES:
        _powers[base] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit hashes."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets; null counts as empty."""
    arr = one_array(column)
    if arr.null_count or pa.types.is_null(arr.type):
        arr = pc.fill_null(arr.cast(pa.large_string()), "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offsets, data = arr.buffers()
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(raw: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, offsets) for runs of whole documents of about `limit` bytes."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(raw: np.ndarray, off: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, 64-bit hash, start byte) of each word of lower-cased texts, in order."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, U64), np.zeros(0, np.int64)
    low = LOWER[raw]
    inside = word_byte[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = inside[heads]
    start = np.flatnonzero(first)
    acc = np.empty(n + 1, U64)
    acc[0] = 0
    value = low.astype(U64)
    value += U64(1)
    value *= _power_table(_ROOT, n)
    value *= inside
    np.cumsum(value, out=acc[1:])
    stop = np.append(start[1:], n)
    h = (acc[stop] - acc[start]) * _power_table(_ROOT_INVERSE, n + 1)[start]
    per = np.add.reduceat(first, heads) if len(heads) else np.zeros(0, np.int64)
    counts = np.zeros(len(off) - 1, np.int64)
    counts[np.flatnonzero(off[:-1] < off[1:])] = per
    return np.repeat(np.arange(len(counts), dtype=np.int32), counts), mix(h), start


def spans(raw: np.ndarray, off: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of each word of lower-cased texts, in order, and the lower-cased bytes."""
    low = LOWER[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), low
    inside = word_byte[low]
    full = off[:-1] < off[1:]
    heads, tails = off[:-1][full], off[1:][full] - 1
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[heads], last[tails] = inside[heads], inside[tails]
    start = np.flatnonzero(first)
    return np.searchsorted(off, start, side="right") - 1, start, np.flatnonzero(last) + 1, low


def word_ends(raw: np.ndarray, off: np.ndarray, word_byte: np.ndarray) -> np.ndarray:
    """The byte behind each word, in the order of words()."""
    if not len(raw):
        return np.zeros(0, np.int64)
    inside = word_byte[LOWER[raw]]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = off[1:][off[:-1] < off[1:]] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(last) + 1


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k word hashes, over document borders too."""
    if len(h) < k:
        return np.zeros(0, U64)
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out *= U64(_ROOT)
        out += h[i : len(h) - k + 1 + i]
    return mix(out)


def byte_grams(raw: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all strings of q bytes, over document borders too."""
    n = len(raw)
    if n < q:
        return np.zeros(0, U64)
    acc = np.empty(n + 1, U64)
    acc[0] = 0
    value = raw.astype(U64)
    value += U64(1)
    value *= _power_table(_ROOT, n)
    np.cumsum(value, out=acc[1:])
    h = acc[q:] - acc[:-q]
    h *= _power_table(_ROOT_INVERSE, n + 1)[: n - q + 1]
    return mix(h)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    have, out = 1, a
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[w - have : w - have + n])


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each of n documents begins in a sorted array of document numbers, and the end."""
    return np.searchsorted(doc, np.arange(n + 1))


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... n[i] times, for each i."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
