"""Fuzzy keys from the perfect binary Golay code of 23 bits."""

from __future__ import annotations

import functools

import numpy as np

#: Generator polynomial of the code.
GENERATOR = 0b101011100011
LENGTH, DATA = 23, 12


def _remainder(words: np.ndarray) -> np.ndarray:
    """The syndrome: the word modulo the generator, 11 bits."""
    words = words.copy()
    for bit in range(LENGTH - 1, LENGTH - DATA - 1, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << bit - (LENGTH - DATA), 0).astype(words.dtype)
    return words


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error to the nearest codeword, and the other codewords within distance four of a word.

    Those others exist when the error has weight three: they are the five codewords of weight seven over it, which
    are given as differences of codeword indices; -1 where there are none.
    """
    single = _remainder(1 << np.arange(LENGTH, dtype=np.int64))
    leaders, weights = np.zeros(2048, np.int64), np.zeros(2048, np.int64)
    for a in range(LENGTH):
        leaders[single[a]], weights[single[a]] = 1 << a, 1
        for b in range(a):
            leaders[single[a] ^ single[b]], weights[single[a] ^ single[b]] = 1 << a | 1 << b, 2
            for c in range(b):
                s = single[a] ^ single[b] ^ single[c]
                leaders[s], weights[s] = 1 << a | 1 << b | 1 << c, 3
    data = np.arange(1 << DATA, dtype=np.int64) << (LENGTH - DATA)
    codewords = data ^ _remainder(data)
    seven = codewords[np.bitwise_count(codewords) == 7]
    others = np.full((2048, 5), -1, np.int64)
    for s in np.flatnonzero(weights == 3):
        others[s] = seven[(seven & leaders[s]) == leaders[s]] >> (LENGTH - DATA)
    return leaders, others, weights


def keys(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word six columns: indices of the codewords within distance four, -1 where fewer.

    Two words that differ in at most two bits share one of them.
    """
    leaders, others, _ = _tables()
    syndromes = _remainder(words.astype(np.int64))
    nearest = (words ^ leaders[syndromes]) >> (LENGTH - DATA)
    more = others[syndromes]
    return np.column_stack([nearest, np.where(more >= 0, nearest[:, None] ^ more, -1)])
