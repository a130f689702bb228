"""Near copies at a five-word similarity of 0.8, by Golay keys of a wide SimHash.

The fingerprints of ``simhash`` differ by some nine bits of 64 between texts whose five-word shingles have a Jaccard similarity
of 0.8, so links of four bits miss most of them.  Here a text gets ``LONGS`` times 64 bits from its different shingles.  The first 115 are
five segments of a Golay word each; each pair of segments gives the products of their codeword indices as keys.  Two texts that differ in at most 11 of these
bits have two segments with at most 2 errors each, as four with 3 would be 12, so they share a key; of more distant
ones most do.  Texts that share a key and differ in at most ``MOST_BITS`` of the 115 are verified on all bits: the share of
different ones estimates the angle between the shingle sets, and ``MOST_SHARE`` stands for a similarity of about 0.76, a
standard error under 0.8.

Only the key's first codeword is shuffled, so a text is dealt into some 21 buckets instead of one for each of its 280 keys; the second
codewords are found where a bucket lies.  There the texts of a key that many share are compared with its first and last one, and then
only texts of different groups are compared.  A bucket gives each group as a star, not as pairs.  A bucket of more than ``BUCKET_ROWS``
texts is cut into slices by a hash, and every two slices meet in a bucket of their own, so no pair is lost and no task holds more.
Equal fingerprints are one node.

Defined results: words stand between ASCII white space, A-Z in lower case; null,
empty and wordless texts have the fingerprint zero and are near copies of each other; a text of fewer than five words is one shingle;
repeated shingles count once; a null id stays only if all ids of its group are null, rows of equal ids are one document; a long text is hashed
``CHUNK`` shingles at a time; an empty table gives no rows; other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm import golay
from wireloom.llm.common import ready, sized_broadcast, slices, stage, unused, utf8
from wireloom.llm.components import components
from wireloom.llm.wordhash import gram_hashes, mixed, word_hashes, words

SHINGLE_WORDS, LONGS = 5, 8
SEGMENTS = 5
#: Different bits of the segments that a pair may have to be verified, and the share of all bits it may have to be linked.
MOST_BITS, MOST_SHARE = 29, 0.172
CHUNK = 1 << 14
#: Rows of a bucket that is not cut, rows for a task, rows of whole buckets and pairs that are compared at once.
BUCKET_ROWS, TASK_ROWS, ROWS_AT_ONCE, PAIRS_AT_ONCE = 1 << 16, 1 << 17, 1 << 15, 1 << 20
#: Rows of a key that are compared with its first and last one before each other.
LED = 8
_NODE, _OTHER = ["_p0", "_p1"], ["_q0", "_q1"]
_ALL = [f"_p{i}" for i in range(LONGS)]
_SALTS = np.random.default_rng(23).integers(1, 1 << 63, LONGS, dtype=np.uint64)
#: A value for every byte but white space, upper case as lower case.
_BYTES = np.random.default_rng(29).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BYTES[[*range(0x09, 0x0E), 0x20]] = 0
PAIRS = tuple(combinations(range(SEGMENTS), 2))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``LONGS`` numbers from the word hashes of a text."""
    if not len(hashes):
        return np.zeros(LONGS, np.uint64)
    grams = np.unique(gram_hashes(hashes, min(SHINGLE_WORDS, len(hashes))))
    ones = np.zeros((LONGS, 64), np.int64)
    for at in range(0, len(grams), CHUNK):
        part = grams[at : at + CHUNK]
        for i, salt in enumerate(_SALTS):
            bits = np.unpackbits(mixed(part ^ salt).view(np.uint8).reshape(-1, 8), axis=1)
            ones[i] += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > len(grams), axis=1).view(np.uint64).ravel()


def fingerprints(df: DataFrame, id: str, text: str) -> DataFrame:
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                data, offsets = utf8(part.column(1))
                starts, ends, bounds = words(data, offsets, _BYTES)
                hashes = word_hashes(data, starts, ends, _BYTES)
                prints = [fingerprint(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = np.array(prints, np.uint64).reshape(-1, LONGS).view(np.int64).T
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], ["_id", *_ALL])

    rows = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, {', '.join(f'{p} bigint' for p in _ALL)}")


def _codewords(low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The Golay keys of each segment of the first two numbers of fingerprints."""
    both = [low, (low >> np.uint64(46)) | (high << np.uint64(18)), high]
    cut = [(0, 0), (0, 23), (1, 0), (2, 5), (2, 28)]  # (number, lowest bit) of each segment
    return [golay.keys((both[n] >> np.uint64(bit)).astype(np.int64) & ((1 << golay.LENGTH) - 1)) for n, bit in cut]


def keys(low: np.ndarray, high: np.ndarray, pairs: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the first two numbers of fingerprints for some pairs of segments."""
    near = _codewords(low, high)
    rows, out = [], []
    for i, j in pairs:
        (left, use_left), (right, use_right) = near[i], near[j]
        used = use_left[:, :, None] & use_right[:, None, :]
        key = ((i * SEGMENTS + j) << 24) | (left[:, :, None] << 12) | right[:, None, :]
        rows.append(np.nonzero(used)[0])
        out.append(key[used])
    return np.concatenate(rows), np.concatenate(out)


def _leads(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, lead): a lead is a segment that has a later one, and one of its codewords."""
    rows, out = [], []
    for i, (index, used) in enumerate(_codewords(low, high)[:-1]):
        row, at = np.nonzero(used)
        rows.append(row)
        out.append(i << 12 | index[row, at])
    return np.concatenate(rows), np.concatenate(out)


def _close(prints: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the pairs of rows that are to be verified and pass."""
    last = np.uint64((1 << 51) - 1)  # the last 13 bits of the second number are in no segment
    differ = np.bitwise_count(prints[0][a] ^ prints[0][b]) + np.bitwise_count((prints[1][a] ^ prints[1][b]) & last)
    found = np.flatnonzero(differ <= MOST_BITS)
    a, b = a[found], b[found]
    every = sum((np.bitwise_count(p[a] ^ p[b]).astype(np.int64) for p in prints), np.zeros(len(found), np.int64))
    return found[every <= int(MOST_SHARE * 64 * LONGS)]


def _joined(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``group``, the first row of each row's group, after the groups of rows a and b are put together."""
    x, y = group[a], group[b]
    while True:
        x, y = group[x], group[y]
        apart = x != y
        if not apart.any():
            return group
        x, y = x[apart], y[apart]
        np.minimum.at(group, np.maximum(x, y), np.minimum(x, y))
        while (group[group] != group).any():
            group = group[group]


def _ends(starts: np.ndarray) -> np.ndarray:
    """For each position the end of its run, given which positions start one."""
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], len(starts))[: len(at)]
    return np.repeat(ends, ends - at)


def linked(bucket: np.ndarray, segment: np.ndarray, prints: list[np.ndarray]) -> np.ndarray:
    """The first row of each row's group, for rows of whole buckets (numbers from 0); ``segment`` is that of a bucket's lead."""
    group = np.arange(len(bucket))
    shared = []
    for j, (index, used) in enumerate(_codewords(prints[0], prints[1])):
        rows, at = np.nonzero(used & (segment < j)[:, None])
        key = bucket[rows] << 12 | index[rows, at]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        starts = np.append(True, key[1:] != key[:-1])[: len(key)]
        first = np.flatnonzero(starts)
        ends = _ends(starts)
        begins = np.repeat(first, np.diff(np.append(first, len(key))))
        large = np.flatnonzero(ends - begins > LED)
        for leader in (begins, ends - 1):
            a, b = rows[large], rows[leader[large]]
            found = _close(prints, a, b)
            group = _joined(group, a[found], b[found])
        several = ends - begins > 1
        shared.append((rows[several], key[several]))
    for rows, key in shared:
        order = np.lexsort((group[rows], key))
        rows, key = rows[order], key[order]
        mine = group[rows]
        starts = np.append(True, key[1:] != key[:-1])[: len(key)]
        own = _ends(starts | np.append(True, mine[1:] != mine[:-1])[: len(key)])
        count = _ends(starts) - own  # partners: rows of the key behind those of the own group
        upto = np.cumsum(count)
        at = 0
        while at < len(rows):
            done = upto[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, done + PAIRS_AT_ONCE, "right")))
            some = count[at:stop]
            a = np.repeat(np.arange(at, stop), some)
            b = np.repeat(own[at:stop] - (np.cumsum(some) - some), some) + np.arange(len(a))
            a, b = rows[a], rows[b]
            apart = np.flatnonzero(group[a] != group[b])
            a, b = a[apart], b[apart]
            found = _close(prints, a, b)
            group = _joined(group, a[found], b[found])
            at = stop
    return group


def _buckets(nodes: DataFrame, bucket_rows: int) -> tuple[DataFrame, int]:
    """(_bucket, fingerprint): a row for each bucket of each node; and the number of these rows."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _leads(*(c.to_numpy().view(np.uint64) for c in batch.columns))[1]
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["_lead"])

    counts = nodes.select(*_NODE).mapInArrow(lead, "_lead bigint").groupBy("_lead").count()
    slices_ = np.ones(SEGMENTS << 12, np.int64)
    total = 0
    for lead_, n in counts.collect():  # at most 4,096 for each segment
        if n > bucket_rows:
            slices_[lead_] = -(-2 * n // bucket_rows)
        total += n * int(slices_[lead_])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            rows, leads = _leads(low, high)
            n = slices_[leads]
            mine = (mixed(low ^ mixed(high))[rows] % n.astype(np.uint64)).astype(np.int64)
            rows, leads, mine = (np.repeat(x, n) for x in (rows, leads, mine))
            other = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            bucket = leads << 48 | np.minimum(mine, other) << 24 | np.maximum(mine, other)
            for at in range(0, len(rows), 10_000):
                part = slice(at, at + 10_000)
                taken = batch.take(pa.array(rows[part]))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[part]), *taken.columns], ["_bucket", *_ALL])

    schema = f"_bucket bigint, {', '.join(f'{p} bigint' for p in _ALL)}"
    return nodes.select(*_ALL).mapInArrow(deal, schema), total


def _star(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Of rows of whole buckets, those that another row of their group leads, with their leader."""
    columns = [pa.concat_arrays([b.column(i) for b in batches]).to_numpy() for i in range(1 + LONGS)]
    bucket, prints = columns[0], [c.view(np.uint64) for c in columns[1:]]
    number = np.cumsum(np.append(False, bucket[1:] != bucket[:-1])[: len(bucket)])
    group = linked(number, bucket >> 60, prints)
    led = np.flatnonzero(group != np.arange(len(group)))
    arrays = [columns[1 + i][at] for at in (led, group[led]) for i in range(len(_NODE))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], [*_NODE, *_OTHER])


def _stars(dealt: DataFrame, tasks: int) -> DataFrame:
    """Edges (a, b) of node names: each group of a bucket as a star."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column(0)[-1].as_py()
            if sum(b.num_rows for b in held) < ROWS_AT_ONCE or held[0].column(0)[0].as_py() == last:
                continue
            # Whole buckets go, the last one may go on in the next batch.
            whole, rest = [], []
            for b in held:
                cut = int(np.searchsorted(b.column(0).to_numpy(), last))
                whole.append(b.slice(0, cut))
                if cut < b.num_rows:
                    rest.append(b.slice(cut))
            yield _star(whole)
            held = rest
        if held:
            yield _star(held)

    rows = dealt.repartition(tasks, "_bucket").sortWithinPartitions("_bucket")
    stars = rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in [*_NODE, *_OTHER])).distinct()
    return stars.select(_name("_p0", "_p1").alias("a"), _name("_q0", "_q1").alias("b"))


def _name(low: str, high: str) -> Column:
    return F.concat(*(F.lpad(F.hex(c), 16, "0") for c in (low, high)))


def near_groups(df: DataFrame, id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``df``: id, component_id (the smallest id of its group)."""
    prints = stage(fingerprints(df, id, text), "wide-fingerprints")
    # Equal in the first two numbers is one node; its other numbers are those of one of its texts.
    rest = F.max(F.struct(*_ALL[2:])).alias("rest")
    nodes = prints.groupBy(*_NODE).agg(F.min("_id").alias("_first"), rest)
    nodes = stage(nodes.select(*_NODE, "_first", "rest.*"), "near-nodes")
    dealt, total = _buckets(nodes, bucket_rows)
    found = components(_stars(dealt, -(-total // TASK_ROWS) + 1))
    joined = nodes.select(*_NODE, "_first").join(found, _name(*_NODE) == found["node"], "left").drop("node")
    whole = stage(joined, "near-parts")
    # Only groups of several nodes are joined by name; a node alone keeps its own first id.
    grouped = whole.where("component is not null")
    names = stage(grouped.groupBy("component").agg(F.min("_first").alias("component_id")), "near-names")
    named = grouped.join(sized_broadcast(names), "component").select(*_NODE, "component_id")
    alone = whole.where("component is null").select(*_NODE, F.col("_first").alias("component_id"))
    of_node = stage(named.unionByName(alone), "near-components")
    return prints.join(sized_broadcast(of_node), _NODE).select(F.col("_id").alias(id), "component_id")


def representatives(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their group, with the columns of ``df``."""
    name = unused(df, "_gone")
    found = near_groups(df, id, text)
    other = found.where(~F.col(f"`{id}`").eqNullSafe(F.col("component_id")))
    gone = stage(other.select(F.col(f"`{id}`").alias(name)).distinct(), "near-copies")
    return df.join(sized_broadcast(gone), F.col(f"`{id}`").eqNullSafe(F.col(name)), "left_anti")
