"""Vectorised word kernels over Arrow text columns.

A chunk is a slice of an Arrow column of at most CHUNK_BYTES (or one longer text). Its words are
byte ranges of the UTF-8 buffer; all later steps are numpy passes over those ranges, so no Python
object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S32 = np.uint64(32)
_S29 = np.uint64(29)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _K1
    x ^= x >> _S32
    x *= _K2
    x ^= x >> _S29
    return x


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a concatenation; the order counts."""
    return mix((a * _K2) ^ b)


@dataclass
class Chunk:
    """Rows first..first+n of a batch: their bytes and the words in them."""

    first: int
    n: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # row (from first) of each word
    word_from: np.ndarray  # n + 1 offsets into the words
    offsets: np.ndarray  # n + 1 offsets into data


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def lots(at: np.ndarray, most_bytes: int, most_rows: int = 512) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes (or one longer row), from the offsets of texts."""
    a, rows = 0, len(at) - 1
    while a < rows:
        b = min(rows, a + most_rows, max(a + 1, int(np.searchsorted(at, at[a] + most_bytes, "right")) - 1))
        yield a, b
        a = b


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    data, at = text_buffers(column)
    first, rows = 0, len(column)
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, rows)
        part, offsets = data[at[first] : at[last]], at[first : last + 1] - at[first]
        starts, ends = find_words(part, offsets)
        doc = np.searchsorted(offsets, starts, "right") - 1
        yield Chunk(first, last - first, part, starts, ends, doc, np.searchsorted(starts, offsets, "left"), offsets)
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    begin[cuts] = inside[cuts]
    end[cuts[1:] - 1] = inside[cuts[1:] - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time."""
    left = ends - starts
    h = mix(left.astype(np.uint64) + _K2)
    if not len(starts):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at, which = starts, None
    while len(at):
        x = eight[at] & _MASKS[np.minimum(left, 8)]
        if which is None:
            h = join_hash(h, x)
        else:
            h[which] = join_hash(h[which], x)
        more = np.flatnonzero(left > 8)
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values, built from runs of powers of two."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, run, size = None, 0, h, 1
    while True:
        if k & size:
            out = run[:n].copy() if out is None else join_hash(out, run[done : done + n])
            done += size
        if done == k:
            return out
        run = join_hash(run[:-size], run[size:])
        size *= 2


def window_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost smallest value of each run of w values."""
    n = len(v) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, size = np.arange(len(v), dtype=np.int64), 1
    while size * 2 <= w:
        a, b = best[:-size], best[size:]
        best = np.where(v[b] < v[a], b, a)
        size *= 2
    if size < w:
        a, b = best[:n], best[w - size : w - size + n]
        best = np.where(v[b] < v[a], b, a)
    return best[:n]
