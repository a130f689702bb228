"""Vectorised words of many texts at once: positions and 64-bit hashes from the raw UTF-8 bytes.

A word is a run of ASCII letters, digits and any non-ASCII characters; A-Z count as a-z.  In UTF-8 every
byte of a non-ASCII character is 0x80 or more, so bytes decide.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240601)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _byte_table() -> np.ndarray:
    """A random value for each byte of a word, 0 for every other byte; upper case as lower case."""
    table = np.zeros(256, np.uint64)
    for b in range(256):
        if b >= 0x80 or chr(b).isalnum():
            table[b] = _rng.integers(1, 1 << 63, dtype=np.uint64)
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


BYTE_VALUES = _byte_table()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(
    data: np.ndarray, offsets: np.ndarray, values: np.ndarray = BYTE_VALUES
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, per text, the range of its words: word i of text t has bounds[t] <= i < bounds[t+1].

    A word is a run of bytes that have a value.
    """
    inside = values[data] > 0
    cut = offsets[1:-1][offsets[1:-1] < len(data)]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_VALUES
) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lead, sizes = starts[0], ends - starts
    values, starts = table[data[lead:]], starts - lead
    place = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    # Bytes behind a word's end are 0 in ``values``; their power does not matter.
    np.minimum(place, sizes.max() - 1, out=place)
    return mixed(np.add.reduceat(values * powers(_BASE, int(sizes.max()))[place], starts))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, text borders ignored: n - k + 1 values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, step = np.zeros(n, np.uint64), np.uint64(1)
    for j in range(k):
        total += hashes[j : j + n] * step
        step = np.uint64((int(step) * int(_STEP)) & (2**64 - 1))
    return mixed(total ^ np.uint64(k))
