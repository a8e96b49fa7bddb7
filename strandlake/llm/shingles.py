"""Word shingles of a text, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import xxhash

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 16


def shingle_hashes(text: bytes, ngram: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles of a text, in blocks."""
    words = text.translate(_LOWER).split()
    if not words:
        return
    line, k = b" ".join(words), min(ngram, len(words))
    ends = list(accumulate(words, lambda at, w: at + len(w) + 1, initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends[:-1])]
    ends = ends[k - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(ends), _BLOCK):
        yield np.array([digest(line[a:b], 42) for a, b in zip(starts[i : i + _BLOCK], ends[i : i + _BLOCK])], dtype=np.uint64)


def shingle_set(text: bytes, ngram: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, ngram)]))
