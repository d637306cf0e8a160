"""Vectorised scan of Arrow text columns: words, word hashes and per-document bounds.

Words are ``[^\\x20\\x09-\\x0D]+``.  Texts are scanned as one byte buffer in pieces of about a megabyte (a longer text
is a piece of its own), so memory follows the longest text and never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INV = pow(_BASE, -1, 1 << 64)

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IS_START = (np.arange(256) & 0xC0) != 0x80      # first byte of a code point


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, PIECE + 1)
        p, q = np.full(m, _BASE, np.uint64), np.full(m, _INV, np.uint64)
        p[0] = q[0] = 1
        _pow, _inv = np.cumprod(p), np.cumprod(q)
    return _pow, _inv


def pieces(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its rows) of runs of rows; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(off, off[at] + PIECE, "right")) - 1)
        yield at, data[off[at]: off[to]], off[at: to + 1] - off[at]
        at = to


class Words:
    """Words of the rows of one piece: ``starts``/``ends`` in bytes, ``first[i]`` the first word of row i, ``hashes``."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False, hashes: bool = True):
        self.buf, self.off = (LOWER[buf] if lower else buf), off
        w = IS_WORD[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        before = np.empty(len(buf), bool)
        after = np.empty(len(buf), bool)
        if len(buf):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = w[:-1], w[1:]
            before &= ~edge[:-1]
            after &= ~edge[1:]
        self.starts = np.flatnonzero(w & ~before)
        self.ends = np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.starts, off)
        self.word_bytes = w
        if hashes:
            p, q = _powers(len(buf) + 1)
            total = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(_BYTE[self.buf] * p[: len(buf)], out=total[1:])
            self.hashes = mix((total[self.ends] - total[self.starts]) * q[self.starts])


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows over one run of word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s, c = np.zeros(n, np.uint64), _MUL
    for i in range(k):
        s += h[i: i + n] * c
        c = _U((int(c) * _BASE) & 0xFFFFFFFFFFFFFFFF)
    return mix(s)
