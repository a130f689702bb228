"""Fuzzy keys from the perfect binary Golay code of length 23.

Every 23-bit word is within 3 bits of exactly one of 4,096 codewords.  A word's keys are the codewords
within 4 bits of it: one if its own codeword is at most 2 bits away, else that one and five more.
Two words that differ in at most 2 bits share a key: if one of them is within 2 bits of its codeword, the
other is within 4 of the same; else the word between them decodes within 3, so it is within 4 of both.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS, KEYS = 23, 11, 6
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


def remainder(word: int) -> int:
    """The word as a polynomial over two elements, modulo the generator."""
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = np.array([remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([remainder(x << 12) for x in range(1 << 11)], np.int64)
    found: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            error = sum(1 << b for b in bits)
            mine = found[remainder(error)]
            if weight < 4 or mine[0].bit_count() == 3:
                mine.append(error)
    count = np.array([len(x) for x in found])
    errors = np.array([x + x[:1] * (KEYS - len(x)) for x in found], np.int64)
    return low, high, errors, count


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For n words of 23 bits: n x 6 codeword indices, and which of them are to be used."""
    low, high, errors, count = _tables()
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    index = (words[:, None] ^ errors[syndrome]) >> CHECK_BITS
    return index, np.arange(KEYS) < count[syndrome][:, None]
