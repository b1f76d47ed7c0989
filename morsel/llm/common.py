"""Shared pieces: whole-column numpy views of Arrow text.

Text operators here read Arrow string columns as one byte buffer plus offsets, so that
tokenizing and hashing cost a few numpy passes a batch rather than Python work a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from morsel.scratch import Scratch  # noqa: F401

U64 = np.uint64
#: Bytes of text that numpy passes of hashes take at a time: they hold some 60 bytes for each, which a worker keeps.
BLOCK = 1 << 18
#: Odd multiplier of the word hash; its powers are invertible modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_TABLES = {_BASE: np.ones(1, dtype=U64), pow(_BASE, -1, 1 << 64): np.ones(1, dtype=U64)}

SPACE, PUNCT, LETTER = 0, 1, 2
_CLASS = np.full(256, PUNCT, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_a:_b] = LETTER


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit values."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers of an odd base modulo 2**64, from power 0."""
    if len(_TABLES[base]) < n:
        p = np.full(max(n, 1 << 16), base, dtype=U64)
        p[0] = 1
        _TABLES[base] = np.multiply.accumulate(p)
    return _TABLES[base]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and n + 1 offsets into them; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span lies."""
    n = len(raw)
    if not len(start):
        return np.zeros(0, dtype=U64)
    acc = np.zeros(n + 1, dtype=U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _powers(_BASE, n)[:n], out=acc[1:])
    h = (acc[end] - acc[start]) * _powers(pow(_BASE, -1, 1 << 64), n)[start]
    return mix64(h ^ ((end - start).astype(U64) << U64(56)))


def words(raw: np.ndarray, off: np.ndarray, punctuation: bool = False, spaced: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words of each text: word spans in bytes, and for text i the words first[i] : first[i + 1].

    A word is a run of letters, digits and bytes beyond ASCII; with punctuation, runs of other visible characters count too;
    with spaced, it is whatever stands between white space.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    c = _CLASS[raw]
    if spaced:
        c = np.where(c == SPACE, np.uint8(SPACE), np.uint8(LETTER))
    edge = np.empty(len(raw), dtype=bool)
    edge[0] = True
    np.not_equal(c[1:], c[:-1], out=edge[1:])
    edge[off[:-1][off[:-1] < len(raw)]] = True
    at = np.flatnonzero(edge)
    end = np.append(at[1:], len(raw))
    keep = c[at] != SPACE if punctuation else c[at] == LETTER
    start, end = at[keep], end[keep]
    return start, end, np.searchsorted(start, off)


def blocks(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to at most `most`, or single longer rows."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, side="right")) - 1)
        yield i, j
        i = j


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + count[i] - 1 of all i, one after another."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - count), count)


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i] : first[i + 1]]; an empty range gives 0."""
    acc = np.concatenate([[0], np.cumsum(values)])
    return acc[first[1:]] - acc[first[:-1]]


def run_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run h[start : end] of hashes, the same wherever the run lies."""
    n = len(h)
    acc = np.zeros(n + 1, dtype=U64)
    np.cumsum(h * _powers(_BASE, n)[:n], out=acc[1:])
    return mix64((acc[end] - acc[start]) * _powers(pow(_BASE, -1, 1 << 64), n + 1)[start] + (end - start).astype(U64))
