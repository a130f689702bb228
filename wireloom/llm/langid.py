"""Language identification of mixed text.

Words are runs of letters.  A word's script (from Unicode ranges) narrows its candidates to the languages
that were learned in that script; its score for each is the log likelihood of its letter trigrams, borders
included, and of the word itself if it is short.  A Viterbi pass over the words with a penalty for every
switch labels spans; a text's language is the one with most letters.

The model is counts in a fixed number of hashed buckets, so its size is ``BUCKETS`` times the number of
languages however large the corpus; every language is learned.  Counts cover every training document.

Defined results: null text, text without a letter and any text when nothing was learned are ``und`` with
score 0; equal shares go to the language first in order.  Words are undecided if they are in a script no language
was learned in, or no likelier in the language they are labelled with than in evenly used buckets.  Score is the
share of letters, those of undecided words included, that are in decided words labelled with the answer.  A very
long text is a step of its own; an empty table gives no rows; repeated rows get equal results; columns pass through.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm.common import ready, slices, stage

BUCKETS = 1 << 16
#: Languages whose counts come to the driver, or are held by a counting task, at once.
LANGUAGES_AT_ONCE = 64
#: Weights (letters x languages) looked up at once.
WEIGHTS_AT_ONCE = 1 << 23
SWITCH_PENALTY = 8.0
SMOOTHING = 0.5
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
#: Words up to this many letters are a feature as a whole.
SHORT_WORD = 4
UNDETERMINED = "und"
STEP_BYTES = 1 << 20

# First and last code point of scripts.
SCRIPTS = (
    ("latin", 0x0041, 0x02AF), ("latin", 0x1E00, 0x1EFF), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("arabic", 0xFB50, 0xFEFC), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("hangul", 0x3130, 0x318F),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7A3),
    ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x3FFFF),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(name for name, _, _ in SCRIPTS))


class Model(NamedTuple):
    languages: list[str]
    #: BUCKETS x languages: log likelihoods
    weights: np.ndarray
    #: scripts x languages: whether the language is a candidate
    candidates: np.ndarray


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: its one-character lower case, whether it is a letter, its script."""
    size = 0x110000
    lower = np.arange(size, dtype=np.uint32)
    letter = np.zeros(size, bool)
    for i in range(size):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    script = np.zeros(size, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return lower, letter, script


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    #: words of text t: bounds[t] to bounds[t + 1]
    bounds: np.ndarray
    #: first code point of each text
    origins: np.ndarray
    script: np.ndarray
    #: per letter, and per short word
    letters: np.ndarray
    letter_bucket: np.ndarray
    short: np.ndarray
    short_bucket: np.ndarray


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def words_of(texts: list[str]) -> Words:
    lower, letter, script = _tables()
    # One line feed behind each text keeps words apart.
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    origins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    inside = letter[points]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    low = np.where(inside, lower[points], 0).astype(np.uint64)
    at = np.flatnonzero(inside)
    before, after = np.zeros(len(at), np.uint64), low[at + 1] if len(at) else np.zeros(0, np.uint64)
    before[at > 0] = low[at[at > 0] - 1]
    grams = before * np.uint64(0x9E3779B97F4A7C15) + low[at] * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
    sizes = ends - starts
    short = np.flatnonzero(sizes <= SHORT_WORD)
    whole = np.full(len(short), 0x5851F42D4C957F2D, np.uint64)
    for i in range(SHORT_WORD):
        more = sizes[short] > i
        whole[more] = whole[more] * np.uint64(0xD6E8FEB86659FD93) + low[starts[short][more] + i]
    return Words(
        starts, ends, np.searchsorted(starts, origins), origins, script[points[starts]], at, _bucket(grams), short, _bucket(whole)
    )


def decided(words: Words, labels: np.ndarray, model: Model) -> np.ndarray:
    """Whether each word's script has candidates and its features are likelier under its label than even buckets."""
    if not len(words.starts):
        return np.zeros(0, bool)
    sizes = words.ends - words.starts
    first = np.searchsorted(words.letters, words.starts)
    score = np.add.reduceat(model.weights[words.letter_bucket, np.repeat(labels, sizes)], first, dtype=float)
    score[words.short] += model.weights[words.short_bucket, labels[words.short]]
    features = sizes.astype(float)
    features[words.short] += 1
    return model.candidates[words.script].any(axis=1) & (score > -np.log(BUCKETS) * features)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Words x languages: log likelihood below the best candidate; zeros for a script nobody uses."""
    count = len(words.starts)
    if not count:
        return np.zeros((0, len(model.languages)), np.float32)
    first = np.searchsorted(words.letters, words.starts)
    kinds = len(model.languages)
    scores = np.empty((count, kinds), np.float32)
    step = max(WEIGHTS_AT_ONCE // len(words.letter_bucket), 1)
    for k in range(0, kinds, step):
        scores[:, k : k + step] = np.add.reduceat(model.weights[words.letter_bucket, k : k + step], first, axis=0)
    scores[words.short] += model.weights[words.short_bucket]
    may = model.candidates[words.script]
    known = may.any(axis=1)
    scores = np.where(may, scores, -np.inf)
    top = np.max(scores, axis=1, keepdims=True, where=known[:, None], initial=-np.inf)
    top[~known] = 0
    scores = np.maximum(scores - top, -50.0)
    scores[~known] = 0
    return scores


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of every word, each text on its own; one step handles the next word of all texts."""
    labels = np.zeros(len(scores), np.int64)
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, size = bounds[:-1][order], sizes[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1 if len(size) else 1), "right")
    kinds = scores.shape[1]
    back = np.zeros(scores.shape, np.int8 if kinds < 128 else np.int32)
    value = np.zeros((len(size), kinds))
    own = np.arange(kinds)
    for t, n in enumerate(live):
        at = begin[:n] + t
        now = value[:n]
        if t:
            best = now.argmax(axis=1)
            jump = now[np.arange(n), best][:, None] - penalty
            stay = now >= jump
            back[at] = np.where(stay, own, best[:, None])
            now = np.where(stay, now, jump)
        value[:n] = now + scores[at]
    state = value.argmax(axis=1) if kinds else np.zeros(len(size), np.int64)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return labels


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, text) to (language, kind, bucket, n), summed over the whole partition."""
    total: dict[tuple[str, int], np.ndarray] = {}

    def add(language: str, kind: int, found: np.ndarray, size: int) -> None:
        key = (language, kind)
        if key not in total:
            total[key] = np.zeros(size, np.int64)
        total[key] += np.bincount(found, minlength=size)

    def flush() -> Iterator[pa.RecordBatch]:
        for (language, kind), n in total.items():
            where = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(where), pa.string()), pa.array(np.full(len(where), kind, np.int32)),
                 pa.array(where.astype(np.int32)), pa.array(n[where])],
                ["language", "kind", "bucket", "n"],
            )
        total.clear()

    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        for language in dict.fromkeys(names.tolist()):
            mine = batch.column(1).take(pa.array(np.flatnonzero(names == language)))
            for start, stop in slices(mine, STEP_BYTES):
                words = words_of(_texts(mine.slice(start, stop - start)))
                add(language, 0, np.concatenate((words.letter_bucket, words.short_bucket)), BUCKETS)
                add(language, 1, np.repeat(words.script, words.ends - words.starts), len(SCRIPT_NAMES))
        if len(total) > 2 * LANGUAGES_AT_ONCE:
            yield from flush()
    yield from flush()


def fit(df: DataFrame, language: str = "lang", text: str = "text") -> Model:
    """Learn from every row of ``df`` whose language is not null."""
    ready(df.sparkSession)
    rows = df.select(F.col(f"`{language}`").cast("string").alias("language"), F.col(f"`{text}`").alias("text"))
    counts = (
        rows.where("language is not null and text is not null")
        .mapInArrow(_counts, "language string, kind int, bucket int, n bigint")
        .groupBy("language", "kind", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    counts = stage(counts, "language-counts")
    languages = sorted(r[0] for r in counts.where("kind = 1").select("language").distinct().collect())
    weights = np.zeros((BUCKETS, len(languages)), np.float32)
    scripts = np.zeros((len(SCRIPT_NAMES), len(languages)))
    place = {name: i for i, name in enumerate(languages)}
    for i in range(0, len(languages), LANGUAGES_AT_ONCE):
        # At most LANGUAGES_AT_ONCE x (BUCKETS + scripts) rows come here.
        table = counts.where(F.col("language").isin(languages[i : i + LANGUAGES_AT_ONCE])).toArrow()
        column = np.array([place[x] for x in table["language"].to_pylist()], np.int64)
        kind, bucket, n = (table[c].to_numpy() for c in ("kind", "bucket", "n"))
        gram = kind == 0
        weights[bucket[gram], column[gram]] = n[gram]
        scripts[bucket[~gram], column[~gram]] = n[~gram]
    if languages:
        weights = np.log((weights + SMOOTHING) / (weights.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
        scripts /= scripts.sum(axis=0)
    return Model(languages, weights, scripts >= SCRIPT_SHARE)


def label(texts: list[str], model: Model, penalty: float = SWITCH_PENALTY) -> list[tuple[str, float, list[dict]]]:
    """Per text: language, score and labelled spans (start, end in characters, language)."""
    words = words_of(texts)
    if not model.languages:
        return [(UNDETERMINED, 0.0, []) for _ in texts]
    labels = viterbi(word_scores(words, model), words.bounds, penalty)
    sizes = words.ends - words.starts
    known = sizes * decided(words, labels, model)
    out = []
    for t in range(len(texts)):
        a, b = words.bounds[t], words.bounds[t + 1]
        if a == b:
            out.append((UNDETERMINED, 0.0, []))
            continue
        share = np.bincount(labels[a:b], weights=known[a:b], minlength=len(model.languages))
        if not share.any():
            share = np.bincount(labels[a:b], weights=sizes[a:b], minlength=len(model.languages))
        best = int(share.argmax())
        score = known[a:b][labels[a:b] == best].sum() / sizes[a:b].sum()
        cut = np.flatnonzero(np.diff(labels[a:b])) + 1
        spans = [
            {"start": int(words.starts[a + i] - words.origins[t]), "end": int(words.ends[a + j - 1] - words.origins[t]),
             "lang": model.languages[labels[a + i]]}
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), b - a], strict=True)
        ]
        out.append((model.languages[best], float(score), spans))
    return out


_LABELLED = pa.struct([
    ("lang", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))),
])


def labelled(df: DataFrame, model: Model, text: str = "text", penalty: float = SWITCH_PENALTY) -> Column:
    """A struct column for ``df``: lang, score, spans."""
    sent = ready(df.sparkSession).sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang string, score double, spans array<struct<start int, end int, lang string>>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            rows = []
            for start, stop in slices(part, STEP_BYTES):
                found = label(_texts(part.slice(start, stop - start)), sent.value, penalty)
                rows += [{"lang": a, "score": b, "spans": c} for a, b, c in found]
            yield pa.array(rows, _LABELLED)

    return run(F.col(f"`{text}`"))


def held_out(id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id}`").cast("string")) % 3 == 1, F.lit(False))


def fit_on_rest(df: DataFrame, id: str = "doc_id", language: str = "lang", text: str = "text") -> Model:
    """Learn from the documents that are not held out; a null id has no remainder and is not learned from."""
    return fit(df.where(~held_out(id) & F.col(f"`{id}`").isNotNull()), language, text)
