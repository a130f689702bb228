"""SimHash near-duplicates: 64-bit fingerprints linked at 4 or fewer differing bits, found by Golay keys.

The fingerprint is cut into segments of 23, 23 and 18 bits.  Of 4 errors, either both wide segments hold at
most 2 (they share a product of Golay keys), or one wide segment holds 3 or more and the other wide one and
the narrow one hold at most 1 between them, so one of these two is equal and the other shares a Golay key.
That makes about 50 keys a fingerprint, and every linked pair shares at least one.  Pairs that share a key
are compared in full.

Only different fingerprints are compared, copies never meet.  Dense groups do not list their pairs: first
each bucket of the more selective keys links its members to its smallest and largest one; then only buckets
that still hold two components are joined, and only across components.  No pair is skipped that could join
two components, so the components are exact.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like any other; a null
id never names a component unless all its ids are null; rows with equal ids are one document; a very long text is
hashed ``CHUNK`` shingles at a time; an empty table gives no rows; other columns are not read, and
``representatives`` passes them through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wireloom.llm import golay
from wireloom.llm.common import ready, sized_broadcast, stage, unused
from wireloom.llm.components import components

SHINGLE_WORDS, SEED, MOST_BITS = 4, 42, 4
#: (lowest bit, bits) of the three segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Shingles counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned SimHash of the lower-cased (A-Z) words between ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(len(words) - shingle_words + 1, 1)
    last = ends[min(shingle_words, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, n)].tolist(), last[at : at + CHUNK].tolist(), strict=False)
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in spans])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id: str, text: str, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(_id, _print): one row per row."""
    ready(df.sparkSession)
    rows = df.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.array([fingerprint(t.as_py() or b"", shingle_words) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["_id", "_print"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, StructType.fromDDL(f"_id {kind}, _print bigint"))


def fuzzy_keys(prints: np.ndarray, products: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of unsigned fingerprints; ``products`` adds the less selective keys of both wide segments."""
    part = [(prints >> np.uint64(low)).astype(np.int64) & ((1 << bits) - 1) for low, bits in SEGMENTS]
    near = [golay.keys(p) for p in part]
    rows, out = [], []
    for tag, (exact, fuzzy) in enumerate(((1, 2), (2, 1), (0, 2), (2, 0)), 1):
        index, used = near[fuzzy]
        key = (tag << 40) | (part[exact][:, None] << 12) | index
        rows.append(np.nonzero(used)[0])
        out.append(key[used])
    if products:
        (left, use_left), (right, use_right) = near[0], near[1]
        used = use_left[:, :, None] & use_right[:, None, :]
        key = (left[:, :, None] << 12) | right[:, None, :]
        rows.append(np.nonzero(used)[0])
        out.append(key[used])
    return np.concatenate(rows), np.concatenate(out)


def _keyed(prints: DataFrame, products: bool) -> DataFrame:
    """(_print, _part) to (_key, _print, _part), one row per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, part = (batch.column(i).to_numpy() for i in (0, 1))
            rows, keys = fuzzy_keys(values.view(np.uint64), products)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(values[rows]), pa.array(part[rows])], ["_key", "_print", "_part"]
            )

    return prints.mapInArrow(run, "_key bigint, _print bigint, _part bigint")


def _close(a: str, b: str, most: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def link_components(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Distinct fingerprints (column _print) to (_print, _part): components under links of ``most`` bits."""
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"these keys find links of 0 to {MOST_BITS} differing bits")
    own = prints.select("_print", F.col("_print").alias("_part"))
    bucket = Window.partitionBy("_key")
    led = _keyed(own, products=False).select(
        "_print", F.min("_print").over(bucket).alias("_least"), F.max("_print").over(bucket).alias("_most")
    )
    stars = led.select("_print", F.explode(F.array("_least", "_most")).alias("_lead"))
    edges = stars.where((F.col("_print") != F.col("_lead")) & _close("_print", "_lead", most))
    parts = components(edges.select(F.col("_print").alias("a"), F.col("_lead").alias("b")))
    first = stage(
        prints.join(parts, prints["_print"] == parts["node"], "left").select(
            "_print", F.coalesce("component", "_print").alias("_part")
        ),
        "parts",
    )
    mixed = (
        _keyed(first, products=True)
        .select("*", F.min("_part").over(bucket).alias("_low"), F.max("_part").over(bucket).alias("_high"))
        .where("_low < _high")
        .drop("_low", "_high")
    )
    other = mixed.toDF("_key", "_other", "_other_part")
    across = mixed.join(other, "_key").where((F.col("_part") < F.col("_other_part")) & _close("_print", "_other", most))
    joined = components(across.select(F.col("_part").alias("a"), F.col("_other_part").alias("b")))
    return first.join(joined, first["_part"] == joined["node"], "left").select(
        "_print", F.coalesce("component", "_part").alias("_part")
    )


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", most: int = MOST_BITS) -> DataFrame:
    """One row per row of ``df``: id, fingerprint (16 hex digits), component_id."""
    prints = stage(fingerprints(df, id, text), "fingerprints")
    unique = stage(prints.groupBy("_print").agg(F.min("_id").alias("_first")), "unique-fingerprints")
    parts = link_components(unique.select("_print"), most)
    named = stage(unique.join(parts, "_print"), "named-parts")
    names = named.groupBy("_part").agg(F.min("_first").alias("component_id"))
    of_print = stage(named.join(names, "_part").select("_print", "component_id"), "print-components")
    return prints.join(sized_broadcast(of_print), "_print").select(
        F.col("_id").alias(id),
        F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def representatives(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose id names their component, with the columns of ``df``."""
    found = near_duplicates(df, id, text)
    name = unused(df, "_gone")
    other = found.where(~F.col(f"`{id}`").eqNullSafe(F.col("component_id")))
    gone = stage(other.select(F.col(f"`{id}`").alias(name)).distinct(), "near-copies")
    return df.join(sized_broadcast(gone), F.col(f"`{id}`").eqNullSafe(F.col(name)), "left_anti")
