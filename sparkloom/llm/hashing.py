"""Vectorised 64-bit hashing of bytes, shared by the corpus operators.

Every hash is a chain of bijective finalisers over blocks of eight bytes, so no sum over positions
lets whole families of strings cancel, whatever their structure.  Words over ``LONG`` bytes are
hashed by BLAKE2b.
"""

from __future__ import annotations

import hashlib

import numpy as np

U64 = np.uint64
#: Words of more bytes are hashed one by one.
LONG = 64
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xC2B2AE3D27D4EB4F)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x *= _B
        x ^= x >> U64(32)
        x *= _B
        x ^= x >> U64(32)
    return x


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number (a view); zeros follow the last."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]; its length counts too."""
    size = end - start
    with np.errstate(over="ignore"):
        out = size.astype(U64) * _A
    eight, live = _loads(data), np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        live = live[size[live] > k]
        if not len(live):
            break
        out[live] = mix(out[live] ^ (eight[start[live] + k] & _MASK[np.minimum(size[live] - k, 8)]))
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hash of two neighbours from theirs."""
    with np.errstate(over="ignore"):
        out = x * _A
        out += y
        out ^= out >> U64(29)
        out *= _B
    return out


class BlockHash:
    """Hashes of every window of one power of two of bytes, built by doubling from eight; windows and
    spans are chains of such blocks, the last one overlapping."""

    def __init__(self, data: np.ndarray, block: int, kind: int = 0):
        self.size, self.block = len(data), 8
        eight = _loads(data)
        self.raw, self.seed = eight, U64(0x5DEECE66D * (2 * kind + 1))
        if block < 8:
            self.block = max(1, block)
            self.at = mix((eight & _MASK[self.block]) ^ self.seed)
            return
        self.at = mix(eight[: max(0, self.size - 7)] ^ self.seed)
        while self.block * 2 <= block and len(self.at):
            self.at = _join(self.at[: -self.block], self.at[self.block :])
            self.block *= 2

    def windows(self, k: int) -> np.ndarray:
        """Hash of every k-byte window, by start; k is at least the block."""
        n = max(0, self.size - k + 1)
        start = np.arange(n)
        return self.spans(start, start + k) if k != self.block else mix(self.at[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for spans of at least a block; the length counts too."""
        size, b = end - start, self.block
        with np.errstate(over="ignore"):
            out = size.astype(U64) * _C
        if not len(size):
            return out
        every = int(size.min()) - b
        for k in range(0, int(size.max()) - b + 1, b):
            if k <= every:
                out = _join(out, self.at[start + k])
            else:
                live = np.flatnonzero(size >= k + b)
                out[live] = _join(out[live], self.at[start[live] + k])
        return mix(_join(out, self.at[end - b]))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    n, size = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size : w - size + n])
