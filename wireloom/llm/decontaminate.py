"""Benchmark decontamination by winnowing.

For spans of ``t`` words take k-grams of k = (t + 1) // 2 words and keep the smallest k-gram hash of every
t - k + 1 consecutive ones: any span of t words of a document keeps at least one of its own k-grams.
Benchmark items keep all their k-grams, so every shared span of t words meets in the join of document
fingerprints with item fingerprints.  Matched (document, item) pairs are then extended: along each
diagonal where a k-gram agrees, words are compared one by one and every run of t equal words is a hit.
An item shorter than the window is one span of its own length; each such length has fingerprints of its
own kind, so short items are found as surely.

Only fingerprints are shuffled, and only if the benchmark is too large to broadcast after counting.
Texts of documents stay where they are read unless the matches outgrow the same bound.

Defined results: null, empty or wordless text has no words, no hits and is clean; null and wordless items have no
windows; repeated rows are each judged; items with equal texts are all listed; an id that several items have counts
once and has the windows of all of them; an empty table gives no rows, an empty benchmark leaves all documents
clean; a very long text is compared along the diagonals of its shared k-grams only; columns of documents pass
through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wireloom.llm.common import ready, sized_broadcast, slices, stage, utf8
from wireloom.llm.wordhash import gram_hashes, word_hashes, words

WINDOW = 13
#: A document is contaminated when hit words are at least one in this many.
ONE_IN = 20


def gram_size(span: int) -> int:
    return (span + 1) // 2


def _grams(hashes: np.ndarray, bounds: np.ndarray, span: int, winnow: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text number, k-gram hash) for spans of ``span`` words: the winnowed ones, or all."""
    k = gram_size(span)
    w = span - k + 1
    grams = gram_hashes(hashes, k)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(grams)]
    room = bounds[owner + 1] - np.arange(len(grams))
    if not winnow:
        keep = room >= k
    else:
        n = len(grams) - w + 1
        keep = np.zeros(len(grams), bool)
        if n > 0:
            least = grams[:n].copy()
            for j in range(1, w):
                np.minimum(least, grams[j : j + n], out=least)
            whole = room[:n] >= span
            for j in range(w):
                keep[j : j + n] |= whole & (grams[j : j + n] == least)
    # The kind of span is part of the fingerprint.
    return owner[keep], grams[keep] * np.uint64(2 * span + 1)


def _fingerprints(spans: list[int], winnow: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                data, offsets = utf8(batch.column(1).slice(start, stop - start))
                starts, ends, bounds = words(data, offsets)
                hashes = word_hashes(data, starts, ends)
                if not winnow:
                    # An item of fewer words than the window is a span of its own length.
                    sizes = np.diff(bounds)
                for span in spans:
                    owner, prints = _grams(hashes, bounds, span, winnow)
                    if not winnow:
                        mine = np.where(sizes >= WINDOW, WINDOW, sizes)[owner] == span
                        owner, prints = owner[mine], prints[mine]
                    order = np.lexsort((prints, owner))
                    owner, prints = owner[order], prints[order]
                    new = np.ones(len(owner), bool)
                    new[1:] = (owner[1:] != owner[:-1]) | (prints[1:] != prints[:-1])
                    ids = batch.column(0).slice(start, stop - start).take(pa.array(owner[new]))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(prints[new].view(np.int64))], ["_id", "_print"]
                    )

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in slices(batch.column(0)):
            bounds = words(*utf8(batch.column(0).slice(start, stop - start)))[2]
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(bounds).astype(np.int64))], ["n"])


def _numbers(text: bytes, known: dict[bytes, int], grow: bool) -> np.ndarray:
    """Words as numbers, equal exactly for equal words."""
    lowered = text.lower()
    data = np.frombuffer(lowered, np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    cut = [lowered[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    if grow:
        return np.array([known.setdefault(x, len(known)) for x in cut], np.int64)
    return np.array([known.get(x, -1) for x in cut], np.int64)


def hit_words(document: np.ndarray, item: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Extend every agreeing k-gram along its diagonal; True where a run of a whole window covers the word."""
    hit = np.zeros(len(document), bool)
    span = min(window, len(item))
    if not span or len(document) < span:
        return hit
    k = gram_size(span)
    a = gram_hashes(document.astype(np.uint64), k)
    b = gram_hashes(item.astype(np.uint64), k)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    seeds = np.flatnonzero(high > low)
    diagonals = set()
    for i in seeds.tolist():
        diagonals.update((i - order[low[i] : high[i]]).tolist())
    for d in diagonals:
        at = max(d, 0)
        n = min(len(document) - at, len(item) - (at - d))
        same = document[at : at + n] == item[at - d : at - d + n]
        runs = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        for first, end in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
            if end - first >= span:
                hit[at + first : at + end] = True
    return hit


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, items (list of id and text), then the rest, which passes through."""
    for batch in batches:
        counts, hits, found = [], [], []
        texts = batch.column(0).cast(pa.binary())
        for start, stop in slices(texts):
            bounds = words(*utf8(texts.slice(start, stop - start)))[2]
            counts.extend(np.diff(bounds).tolist())
        items = batch.column(1)
        has = items.is_valid().to_pylist()
        for i, some in enumerate(has):
            if not some:
                hits.append(0)
                found.append([])
                continue
            known: dict[bytes, int] = {}
            document = _numbers(texts[i].as_py() or b"", known, grow=True)
            hit, mine = np.zeros(len(document), bool), []
            for item in items[i].as_py():
                one = hit_words(document, _numbers((item["text"] or "").encode(), known, grow=False))
                if one.any():
                    if item["id"] not in mine:  # an id may name several texts
                        mine.append(item["id"])
                    hit |= one
            hits.append(int(hit.sum()))
            found.append(mine)
        arrays = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(found, pa.list_(pa.string()))]
        rest = batch.columns[2:]
        names = ["_n_words", "_n_hit", "_items", *batch.schema.names[2:]]
        yield pa.RecordBatch.from_arrays([*arrays, *rest], names)


def spans_of(benchmark: DataFrame, text: str = "text") -> list[int]:
    """The window and the lengths of items below it: at most ``WINDOW`` numbers."""
    n = benchmark.select(F.col(f"`{text}`")).mapInArrow(_counted, "n bigint")
    short = n.where(F.col("n").between(1, WINDOW - 1)).distinct()
    return sorted({WINDOW, *(r["n"] for r in short.collect())})


def matches(docs: DataFrame, benchmark: DataFrame, doc: str, item: str, text: str) -> DataFrame:
    """Written (id, items): candidates of each document, items with their texts."""
    spans = spans_of(benchmark, text)

    def prints(df: DataFrame, key: str, winnow: bool) -> DataFrame:
        rows = df.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
        out = StructType.fromDDL(f"_id {rows.schema['_id'].dataType.simpleString()}, _print bigint")
        return rows.mapInArrow(_fingerprints(spans, winnow), out)

    index = stage(prints(benchmark, item, winnow=False).distinct(), "benchmark-prints")
    index = index.withColumnRenamed("_id", "_item")
    pairs = (
        prints(docs, doc, winnow=True)
        .join(sized_broadcast(index), "_print")
        .select("_id", "_item")
        .distinct()
    )
    texts = benchmark.select(F.col(f"`{item}`").alias("_item"), F.col(f"`{text}`").alias("_text")).distinct()
    listed = (
        pairs.join(texts, pairs["_item"].eqNullSafe(texts["_item"]))
        .groupBy("_id")
        .agg(F.collect_list(F.struct(texts["_item"].cast("string").alias("id"), F.col("_text").alias("text"))).alias("_found"))
    )
    return stage(listed, "benchmark-matches")


def decontamination(
    docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text",
) -> DataFrame:
    """All columns of ``docs`` as ``_c0, _c1 ...`` behind _n_words, _n_hit, _items (ids as text)."""
    ready(docs.sparkSession)
    size = F.aggregate("_found", F.lit(0), lambda n, f: n + F.octet_length(f["text"]))
    found = sized_broadcast(matches(docs, benchmark, doc, item, text), size=size)
    found = found.withColumnRenamed("_id", "_match")
    rows = docs.select(
        F.col(f"`{text}`").alias("_text"), F.col(f"`{doc}`").alias("_key"),
        *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)),
    )
    joined = rows.join(found, F.col("_key").eqNullSafe(F.col("_match")), "left")
    kept = [f for f in joined.schema if f.name.startswith("_c")]
    out = StructType.fromDDL("_n_words bigint, _n_hit bigint, _items array<string>")
    for f in kept:
        out.add(f)
    return joined.select("_text", F.col("_found"), *(f.name for f in kept)).mapInArrow(_judged, out)


def contaminated(n_words: str = "_n_words", n_hit: str = "_n_hit") -> Column:
    return (F.col(n_hit) > 0) & (ONE_IN * F.col(n_hit) >= F.col(n_words))


def clean(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    rows = decontamination(docs, benchmark, doc, item, text).where(~contaminated())
    return rows.select(*(F.col(f"_c{i}") for i in range(len(docs.columns)))).toDF(*docs.columns)
