"""Minimal acyclic transducer: a set of byte strings compiled into a shared-suffix automaton.

Equal continuations are one state, built incrementally from sorted words.  Every transition carries how many
words sort before its target's, so adding them up along a word's path gives the word's number, and the
number leads to the word's token ids.  The file is a few flat arrays, to be memory-mapped: processes of one
machine share its pages.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence
from pathlib import Path

import numpy as np

MAGIC = b"MATL0001"
#: name and type of the arrays, in file order
ARRAYS = (
    ("keys", "<i8"),  # state * 256 + byte, ascending
    ("target", "<i4"),
    ("ahead", "<i4"),  # words that sort before those through this transition, within the state
    ("final", "u1"),
    ("first", "<i8"),  # ids of word i: first[i] to first[i + 1]
    ("ids", "<u4"),
)


class _Builder:
    def __init__(self):
        self.states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        self.known: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}
        self.path: list[list] = [[False, []]]  # open states: final, transitions
        self.word = b""

    def _close(self, depth: int) -> None:
        """Freeze open states deeper than ``depth``; equal ones become one."""
        while len(self.path) > depth + 1:
            final, edges = self.path.pop()
            state = (final, tuple(edges))
            number = self.known.setdefault(state, len(self.states))
            if number == len(self.states):
                self.states.append(state)
            self.path[-1][1].append((self.word[len(self.path) - 1], number))

    def add(self, word: bytes) -> None:
        same = 0
        while same < min(len(word), len(self.word)) and word[same] == self.word[same]:
            same += 1
        self._close(same)
        self.word = word
        self.path += [[False, []] for _ in range(len(word) - same)]
        self.path[-1][0] = True

    def end(self) -> int:
        self._close(0)
        final, edges = self.path[0]
        self.states.append((final, tuple(edges)))
        return len(self.states) - 1


def compile_lexicon(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """The file of words and their ids; words are distinct and not empty."""
    entries = sorted(entries)
    build = _Builder()
    for word, _ in entries:
        build.add(word)
    root = build.end()
    size = [0] * len(build.states)  # words from a state on; targets come before their sources
    keys, target, ahead = [], [], []
    for state, (final, edges) in enumerate(build.states):
        n = int(final)
        for byte, to in edges:
            keys.append(state * 256 + byte)
            target.append(to)
            ahead.append(n)
            n += size[to]
        size[state] = n
    lengths = [len(ids) for _, ids in entries]
    arrays = {
        "keys": keys, "target": target, "ahead": ahead, "final": [f for f, _ in build.states],
        "first": np.concatenate(([0], np.cumsum(lengths))), "ids": [i for _, ids in entries for i in ids],
    }
    body, head = [], [MAGIC, struct.pack("<q", root)]
    for name, kind in ARRAYS:
        data = np.asarray(arrays[name]).astype(kind).tobytes()
        head.append(struct.pack("<q", len(data)))
        body.append(data + b"\0" * (-len(data) % 8))
    return b"".join(head + body)


class Lexicon:
    def __init__(self, path: str | Path):
        whole = np.memmap(path, np.uint8, "r")
        if bytes(whole[:8]) != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        head = np.frombuffer(whole[8 : 16 + 8 * len(ARRAYS)], "<i8")
        self.root, at = int(head[0]), 16 + 8 * len(ARRAYS)
        for (name, kind), size in zip(ARRAYS, head[1:].tolist(), strict=True):
            setattr(self, name, whole[at : at + size].view(kind))
            at += size + -size % 8

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word, -1 if it is not in the lexicon; all words move on together."""
        n = len(words)
        found = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return found
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, n)
        start = np.cumsum(size) - size
        live = np.flatnonzero(size > 0)
        state, number = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state * 256 + data[start[live] + step]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            goes = self.keys[at] == key
            live, at, number = live[goes], at[goes], number[goes]
            state, number = self.target[at].astype(np.int64), number + self.ahead[at]
            step += 1
            ends = size[live] == step
            accepted = ends & (self.final[state] > 0)
            found[live[accepted]] = number[accepted]
            live, state, number = live[~ends], state[~ends], number[~ends]
        return found

    def ids_of(self, number: int) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        return self.ids[self.first[number] : self.first[number + 1]].tobytes()
