"""Words of a text as 64-bit hashes, and hashes of word sequences, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker keeps, about 12 MB; it starts anew beyond that.
CACHE = 100_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_D = np.uint64(0xA0761D6478BD642F)


class WordHashes(dict):
    """Word bytes to a 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(a: np.ndarray, b: np.ndarray, salt: np.uint64 = _C) -> np.ndarray:
    """A hash of the ordered pair."""
    x = a * _A + (b ^ salt) * _B
    x ^= x >> np.uint64(29)
    x *= _D
    return x ^ (x >> np.uint64(32))


def sequences(words: np.ndarray, size: int, salt: np.uint64 = _C) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words, by doubling."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, at, block, step = None, 0, words, 1
    left = size
    while left:
        if left & 1:
            part = block[at : at + n]
            out = part if out is None else mixed(out, part, salt)
            at += step
        left >>= 1
        if left:
            block = mixed(block[:-step], block[step:], salt)
            step *= 2
    return mixed(out, np.array([size], np.uint64), salt)
