"""Distinct word shingles of documents as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from sparkloom.llm.batches import LOWER, SPACED, slices, words
from sparkloom.llm.hashing import U64, mix, word_keys

_FACTORS = np.random.Generator(np.random.PCG64(0xC0FFEE)).integers(0, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED):
    """(hash, row, start, end) of each lower-cased word."""
    low = LOWER[data]
    start, end, row = words(low, offsets, table)
    return word_keys(low, start, end), row, start, end


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    with np.errstate(over="ignore"):
        out = h[:n] * _FACTORS[0]
        for j in range(1, k):
            out += h[j : j + n] * _FACTORS[j]
    return mix(out)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct k-word shingles; with fewer words the whole sequence is one."""
    for i, j, data, offsets in slices(column):
        h, row, _, _ = word_hashes(data, offsets)
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        joined = combine(h, k)
        for r in range(j - i):
            a, b = int(bounds[r]), int(bounds[r + 1])
            if b - a >= k:
                yield np.unique(joined[a : b - k + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    yield mix(np.array([(h[a:b] * _FACTORS[32 : 32 + b - a]).sum(dtype=U64) + U64(b - a)], U64))
            else:
                yield np.zeros(0, U64)
