"""Vectorised work on batches of texts: one byte buffer, document offsets, word spans and word hashes.

All hashes are polynomials modulo 2^64 with an odd base, taken from prefix sums, then scrambled. Word and window
hashes of a batch cost a few passes over its bytes; no Python loop runs over words.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BATCH_BYTES = (1 << 19) - 64
#: Space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes outside A-Z, a-z, 0-9 and non-ASCII.
PUNCT = np.ones(256, bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def scramble(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit words."""
    x = np.asarray(x, U).copy()
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, U(b))
        p[0] = U(1)
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


_kept_powers = functools.lru_cache(16)(_powers)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and its inverse powers; at least n of each. Those for a batch of usual size are kept, those for a very long text aren't."""
    for size in (1 << 17, 1 << 19, 1 << 20):
        if n <= size:
            return _kept_powers(base, size)
    return _powers(base, n)


_owner: list = [None, None]
#: Only glibc has it; elsewhere nothing is trimmed but Arrow's pool.
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
TRIM_BYTES = 1 << 22


def trim() -> None:
    """Gives freed memory back to the system. Allocators keep up to a few hundred MB of it, which an idle worker would hold while others work."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def claim(owner: str, release: Callable[[], None] | None = None) -> None:
    """Says which operator a worker process works for; what the one before kept in memory is released."""
    if _owner[0] != owner:
        if _owner[1]:
            _owner[1]()
        _owner[:] = owner, release
        trim()


BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
BYTE_CODE = scramble(np.arange(1, 257, dtype=U))


@dataclass
class Words:
    """Words of a batch in order. start, end: byte spans in the buffer. first: for each document, its first word's number; one more at the end."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document (position in the batch) of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self) -> np.ndarray:
        code = BYTE_CODE[self.buf]
        p, q = powers(BYTE_BASE, len(code) + 1)
        code *= p[: len(code)]
        c = np.zeros(len(code) + 1, U)
        np.cumsum(code, out=c[1:])
        h = (c[self.end] - c[self.start]) * q[self.start]
        return scramble(h + (self.end - self.start).astype(U) * U(0x9FB21C651E98DF25))


def find_words(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that aren't in space; none crosses a document's end."""
    w = ~space[buf]
    n = len(buf)
    a, z = np.empty(n, bool), np.empty(n, bool)
    if n:
        a[0], z[-1] = w[0], w[-1]
        np.logical_and(w[1:], ~w[:-1], out=a[1:])
        np.logical_and(w[:-1], ~w[1:], out=z[:-1])
        at = offsets[(offsets > 0) & (offsets < n)]
        a[at] = w[at]
        z[at - 1] = w[at - 1]
    start, end = np.flatnonzero(a), np.flatnonzero(z) + 1
    return Words(buf, start, end, np.searchsorted(start, offsets))


def rolling(h: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """Hashes of all runs of k consecutive entries (also across documents; the caller leaves those out)."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    p, q = powers(base, n + 1)
    c = np.zeros(n + 1, U)
    np.cumsum(h * p[:n], out=c[1:])
    return scramble((c[k:] - c[:-k]) * q[: n - k + 1])


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = WORD_BASE) -> np.ndarray:
    """Hash of the entries from start to end, for each pair."""
    p, q = powers(base, len(h) + 1)
    c = np.zeros(len(h) + 1, U)
    np.cumsum(h * p[: len(h)], out=c[1:])
    return scramble((c[end] - c[start]) * q[start] + (end - start).astype(U) * U(0x9FB21C651E98DF25))


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a text column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if off is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def pieces(col: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits a text column into runs of rows of at most so many bytes (one row at least): first row, last row + 1, buffer, offsets."""
    claim("texts")
    buf, off = _bytes_of(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    if len(buf) >= TRIM_BYTES:
        trim()
