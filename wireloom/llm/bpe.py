"""Byte-level BPE encoding and decoding with a frequent-word lexicon.

Words of all texts are counted by Spark; those that are at least one in ``FREQUENT`` of all words (so never
more than ``FREQUENT`` of them) are merged once and compiled into a minimal acyclic transducer, which goes
to the executors as a file and is memory-mapped there.  Any other word is merged exactly: the lowest-ranked
pair first, the leftmost of equal ones.  Many unseen words are merged together, one merge of each per step.

Special tokens in a text become their ids, as the tokenizer file says.  Ids are bytes, little-endian
unsigned 32-bit, the form token files are stored in; ``F.octet_length(ids) / 4`` is their number.

Defined results: null and empty texts have no ids and decode to the empty text; decoding null gives the
empty text; bytes that are not UTF-8 decode to the replacement character; a very long text is a step of its own,
its words are still coded one by one; an empty table gives no rows and a lexicon without words; repeated rows
get equal ids; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wireloom.llm.common import ready, slices, stage
from wireloom.llm.lexicon import Lexicon, compile_lexicon

# Fixed value: white space as the split pattern of byte-level tokenizers has it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER, NUMBER, OTHER, BLANK, BORDER = range(5)
# Letters and numbers of Unicode 16.0, the version the tokenizer files are read with, that
# Unicode 15.1 lacks.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)
#: Stands between texts; no UTF-8 text holds it.
_BORDER = "\udfff"

FREQUENT = 500_000
#: Different words counted in a task before they are handed on.
COUNTED_WORDS = 200_000
#: Words a task remembers with their ids.
KNOWN_WORDS = 250_000
#: Longer words are merged one by one with a heap.
TOGETHER_BYTES = 48
#: Words merged in one go.
TOGETHER = 1 << 14
NONE = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in plain):
        letters[chr(256 + i)] = b
    return letters


@functools.cache
def _kinds() -> np.ndarray:
    """Per code point: letter, number, blank, other, or the border between texts."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        first = unicodedata.category(chr(i))[0]
        if first in "LN":
            kinds[i] = LETTER if first == "L" else NUMBER
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            kinds[first : last + 1] = kind
    kinds[[ord(c) for c in BLANKS]] = BLANK
    kinds[ord(_BORDER)] = BORDER
    return kinds


def split_words(texts: Sequence[str]) -> list[list[str]]:
    """Words of many texts: runs of one kind, each with one space before it.

    Of several blanks before a word all but the last are a word; the last is one of its own unless it is a
    space.  An apostrophe that begins a word takes one of the endings s, t, m, d, re, ve, ll with it.
    """
    joined = _BORDER.join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[points]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[kind == BORDER] = True
    # The last blank before something else.
    last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] < BLANK))
    new[last] = True
    new[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points == 39) & new)
    quote = quote[kind[np.minimum(quote + 1, len(kind) - 1)] == LETTER]
    if len(quote):
        one, two = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        e = (two == ord("e")) & ((one == ord("r")) | (one == ord("v")))
        long = e | ((one == ord("l")) & (two == ord("l")))
        new[quote[short | long] + 1] = False
        new[quote[short] + 2] = True
        new[quote[long] + 3] = True
    starts = np.flatnonzero(new)
    at = starts.tolist()
    words = [joined[a:b] for a, b in zip(at, at[1:], strict=False)]
    ends = np.flatnonzero(kind[starts] == BORDER).tolist()
    return [words[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)]


class _Pairs:
    """Rank of token pairs in an open hash table that is read for many pairs at once."""

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.shift = np.uint64(64 - max(8, (4 * len(merges)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        wanted = np.array([a << 32 | b for a, b in merges], np.int64)
        for key, place, (rank, _) in zip(wanted.tolist(), self._place(wanted).tolist(), merges.values(), strict=True):
            while self.keys[place] >= 0:
                place = (place + 1) & self.mask
            self.keys[place], self.ranks[place] = key, rank

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        place = self._place(keys)
        found = self.keys[place]
        ranks = np.where(found == keys, self.ranks[place], NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & self.mask
            found = self.keys[place[open_]]
            hit = found == keys[open_]
            ranks[open_[hit]] = self.ranks[place[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return ranks


class Tokenizer:
    """Vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        vocabulary = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in vocabulary.items() if t not in self.special}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.pieces = np.array([self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)], object)
        self.base = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.base[b] = vocabulary[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocabulary[left], vocabulary[right]), (rank, vocabulary[left + right]))
        self.pairs = _Pairs(self.merges)
        self.made = np.zeros(len(told["model"]["merges"]), np.int32)
        for rank, made in self.merges.values():
            self.made[rank] = made
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def words(self, texts: Sequence[str]) -> list[list[str]]:
        """Words of each text; special tokens are words of their own."""
        if self.cut is None or not any(s in t for t in texts for s in self.special):
            return split_words(texts)
        parts = [self.cut.split(t) for t in texts]
        plain = iter(split_words([p for own in parts for p in own[::2]]))
        out = []
        for own in parts:
            words = next(plain)
            for special in own[1::2]:
                words = [*words, special, *next(plain)]
            out.append(words)
        return out

    def merged(self, word: bytes) -> list[int]:
        """One word, exactly, in time n log n: merges wait in a heap by rank, then place."""
        ids = self.base[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        waiting: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(ids) and (found := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(waiting, (found[0], i, j, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i, i + 1)
        while waiting:
            _, i, j, a, b = heapq.heappop(waiting)
            if ids[i] != a or after[i] != j or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [i for i in ids if i >= 0]

    def merged_together(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids of many words as bytes."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > TOGETHER_BYTES:
                out[i] = np.array(self.merged(w), "<u4").tobytes()
            else:
                short.append(i)
        short.sort(key=lambda i: len(words[i]))
        for at in range(0, len(short), TOGETHER):
            self._step(words, short[at : at + TOGETHER], out)
        return out

    def _step(self, words: Sequence[bytes], which: list[int], out: list[bytes]) -> None:
        size = np.array([len(words[i]) for i in which])
        width = int(size.max())
        grid = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in which), np.uint8).reshape(-1, width)
        used = np.arange(width) < size[:, None]
        ids = np.where(used, self.base[grid], -1)
        ranks = np.full((len(which), width), NONE, np.int32)
        pairs = used[:, 1:]
        ranks[:, :-1][pairs] = self.pairs.rank(ids[:, :-1][pairs], ids[:, 1:][pairs])
        rows = np.array(which)
        while len(rows):
            place = ranks.argmin(axis=1)
            mine = np.arange(len(rows))
            best = ranks[mine, place]
            open_ = best < NONE
            if not open_.all():
                done = ids[~open_]
                flat = done[done >= 0].astype("<u4").tobytes()
                ends = 4 * np.cumsum((done >= 0).sum(axis=1))
                for r, a, b in zip(rows[~open_].tolist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                    out[r] = flat[a:b]
                rows, ids, ranks, place, best = rows[open_], ids[open_], ranks[open_], place[open_], best[open_]
                mine = np.arange(len(rows))
                if not len(rows):
                    break
            # The right half of the pair goes; everything behind it moves one place to the left.
            width = ids.shape[1] - 1
            behind = np.arange(width) > place[:, None]
            ids = np.where(behind, ids[:, 1:], ids[:, :-1])
            ranks = np.where(behind, ranks[:, 1:], ranks[:, :-1])
            ids[mine, place] = self.made[best]
            left = np.concatenate((place - 1, place))
            row = np.concatenate((mine, mine))
            real = left >= 0
            left, row = left[real], row[real]
            right = np.minimum(left + 1, width - 1)
            fits = (left + 1 < width) & (ids[row, right] >= 0)
            changed = np.full(len(row), NONE, np.int32)
            changed[fits] = self.pairs.rank(ids[row[fits], left[fits]], ids[row[fits], right[fits]])
            ranks[row, left] = changed


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


class Encoder:
    """Words to ids: what the task knows, then the lexicon, then exact merges."""

    def __init__(self, tokens: Tokenizer, lexicon: Lexicon | None = None):
        self.tokens, self.lexicon = tokens, lexicon
        self.known: dict[str, bytes] = {}
        self.fixed = {w: np.array([i], "<u4").tobytes() for w, i in tokens.special.items()}

    def learn(self, wanted: set[str]) -> None:
        missing = [w for w in wanted if w not in self.known]
        if len(self.known) + len(missing) > KNOWN_WORDS:
            self.known = {}
            missing = list(wanted)
        plain = []
        for w in missing:
            if w in self.fixed:
                self.known[w] = self.fixed[w]
            else:
                plain.append(w)
        coded = [w.encode() for w in plain]
        unseen = range(len(plain))
        if self.lexicon is not None:
            numbers = self.lexicon.numbers(coded).tolist()
            for w, number in zip(plain, numbers, strict=True):
                if number >= 0:
                    self.known[w] = self.lexicon.ids_of(number)
            unseen = [i for i, number in enumerate(numbers) if number < 0]
        ids = self.tokens.merged_together([coded[i] for i in unseen])
        self.known.update(zip((plain[i] for i in unseen), ids, strict=True))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        split = self.tokens.words(texts)
        self.learn(set().union(*split))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def word_counts(df: DataFrame, tokens: str, text: str = "text") -> DataFrame:
    """(word, n) over all texts; each task hands on what it has counted, at most ``COUNTED_WORDS`` at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count = tokenizer(tokens), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], ["word", "n"])
            count.clear()
            return out

        for batch in batches:
            for start, stop in slices(batch.column(0)):
                for words in own.words([t or "" for t in batch.column(0).slice(start, stop - start).to_pylist()]):
                    count.update(words)
                if len(count) > COUNTED_WORDS:
                    yield flush()
        yield flush()

    rows = ready(df.sparkSession) and df.select(F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, tokens: str, text: str = "text", frequent: int = FREQUENT) -> str:
    """Compile the frequent words of ``df`` and send the file to all executors; returns its name."""
    spark = df.sparkSession
    counts = stage(word_counts(df, tokens, text), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # A word needs n * frequent >= total, so no more than ``frequent`` words come to the driver.
    chosen = counts.where(F.col("n") * F.lit(frequent) >= total).select("word").toArrow()["word"].to_pylist()
    own = tokenizer(tokens)
    words = [w.encode() for w in chosen if w not in own.special]
    ids = [np.frombuffer(x, "<u4").tolist() for x in own.merged_together(words)]
    name = f"lexicon-{uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), name)
    with open(path, "wb") as f:
        f.write(compile_lexicon(zip(words, ids, strict=True)))
    spark.sparkContext.addFile(path)
    return name


@functools.lru_cache(maxsize=1)
def _encoder(tokens: str, lexicon: str) -> Encoder:
    return Encoder(tokenizer(tokens), Lexicon(SparkFiles.get(lexicon)))


def encoded(df: DataFrame, tokens: str, lexicon: str, text: str = "text", check: bool = False) -> DataFrame:
    """``df`` without its text column, and with ``ids``; with ``check`` also ``decoded``, read back from them.

    Columns of ``df`` that have these names are replaced.
    """
    rest = [c for c in df.columns if c not in (text, "ids", *["decoded"] * check)]
    rows = df.select(F.col(f"`{text}`").alias("_text"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)))
    out = StructType(rows.schema.fields[1:]).add("_ids", "binary")
    if check:
        out = out.add("_decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(tokens, lexicon)
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                part = batch.slice(start, stop - start)
                ids = own.encode([t or "" for t in part.column(0).to_pylist()])
                arrays, names = [*part.columns[1:], pa.array(ids, pa.binary())], [*part.schema.names[1:], "_ids"]
                if check:
                    arrays.append(pa.array([decode_bytes(x, own.tokens) for x in ids], pa.string()))
                    names.append("_decoded")
                yield pa.RecordBatch.from_arrays(arrays, names)
        own.known = {}  # the worker may live on for other work

    return rows.mapInArrow(run, out).toDF(*rest, "ids", *["decoded"] * check)


def decode_bytes(ids: bytes, tokens: Tokenizer) -> str:
    return b"".join(tokens.pieces[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


def decoded(ids: Column, tokens: str) -> Column:
    """The text of an ids column."""

    @F.arrow_udf("string")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = tokenizer(tokens)
        for part in parts:
            yield pa.array([decode_bytes(x.as_py() or b"", own) for x in part], pa.string())

    return run(ids)
