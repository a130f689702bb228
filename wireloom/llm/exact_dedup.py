"""Exact dedup by content sort.

Rows are range-partitioned by (first bytes, hash, id) with splitters Spark samples, then sorted inside
each partition by (first bytes, hash, text, id), which spills to disk when needed.  Equal texts become
neighbours and one pass compares each text with the one before it in full.  The id in the splitters
lets a group of any size spread over many partitions; a group that crosses partitions is put together
from one row per partition edge, again by its full text.  Splitter keys are short, so the sample the
driver sees stays small however long the texts are.

Defined results: null text counts as empty; a null id is smaller than any other; of rows with equal
text and equal id one stays.  A very long text is compared whole, like any other.  An empty table gives an empty
result.  Other columns are not read, or pass through with the rows that stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wireloom.llm.common import ready, stage

#: Leading bytes of a text in the splitters.
PREFIX_BYTES = 16

#: Rows of one run whose output is held back until the run ends or this many are waiting.
ROWS_OUT = 5000

_MADE = "_id {id}, _keep {id}, _size bigint, _head boolean, _sha string, _edge bigint, _edge_text binary"


class _Runs:
    """Walks sorted rows; a run is a stretch of equal texts."""

    def __init__(self, pid: int):
        self.pid, self.n, self.text = pid, 0, None
        self.ids: list = []
        self.rows: list[tuple] = []

    def add(self, text: bytes, key) -> None:
        if text != self.text:
            self.end(last=False)
            self.text = text
        self.ids.append(key)

    def end(self, last: bool) -> None:
        if not self.ids:
            return
        edge = 2 * self.pid + int(self.n > 0) if self.n == 0 or last else None
        sha, keep, size = hashlib.sha256(self.text).hexdigest(), self.ids[0], len(self.ids)
        shown = None if edge is None else self.text
        for i, key in enumerate(self.ids):
            self.rows.append((key, keep, size, i == 0, sha, edge, shown if i == 0 else None))
        self.n += 1
        self.ids = []


def sorted_runs(df: DataFrame, id: str, text: str, carry: bool = False) -> DataFrame:
    """The written runs: per row its id, the run's first id, size, digest and edge.

    With ``carry`` only the first row of each run is kept, with all columns of ``df`` as ``_c0, _c1 ...``.
    Rows of one run in one partition are held as ids until the run ends; the partition bounds them.
    """
    ready(df.sparkSession)
    kind = df.schema[id].dataType
    columns = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)] if carry else []
    body = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    rows = df.select(F.col(f"`{id}`").alias("_id"), body.alias("_text"), *columns)
    key = [F.substring("_text", 1, PREFIX_BYTES), F.xxhash64("_text")]
    last = F.col("_id").desc_nulls_last()
    placed = rows.repartitionByRange(*key, last).sortWithinPartitions(*key, "_text", last)

    made = StructType.fromDDL(_MADE.format(id=kind.simpleString()))
    kept = [f for f in placed.schema if f.name.startswith("_c")]
    out = StructType([*made.fields, *(StructField(f.name, f.dataType) for f in kept)])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, shapes, held = _Runs(TaskContext.get().partitionId()), None, []
        for batch in batches:
            shapes = shapes or [batch.schema.field(0).type, *(batch.schema.field(f.name).type for f in kept)]
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (key_, text_) in enumerate(zip(ids, texts, strict=True)):
                if carry and text_ != runs.text:
                    held.append(batch.slice(i, 1))
                runs.add(text_, key_)
            if len(runs.rows) >= ROWS_OUT or carry:
                yield from _out(runs, shapes, held if carry else None, kept)
        runs.end(last=True)
        yield from _out(runs, shapes, held if carry else None, kept)

    return stage(placed.mapInArrow(walk, out), "content-runs")


def _out(runs: _Runs, shapes, held, kept) -> Iterator[pa.RecordBatch]:
    rows = [r for r in runs.rows if r[3]] if held is not None else runs.rows
    if not rows:
        return
    runs.rows = []
    cols = list(zip(*rows, strict=True))
    types = [shapes[0], shapes[0], pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
    names = ["_id", "_keep", "_size", "_head", "_sha", "_edge", "_edge_text"]
    if held is not None:
        whole = pa.Table.from_batches(held[: len(rows)]).combine_chunks()
        del held[: len(rows)]
        arrays += [whole.column(f.name).combine_chunks() for f in kept]
        arrays = [a.chunk(0) if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        names += [f.name for f in kept]
    yield pa.RecordBatch.from_arrays(arrays, names)


def _joined(runs: DataFrame) -> DataFrame:
    """Runs that cross partitions put together: at most two edge rows a partition, a proven bound."""
    edges = runs.where(F.col("_edge_text").isNotNull())
    whole = edges.groupBy("_edge_text").agg(
        F.max("_keep").alias("_whole_keep"),
        F.sum("_size").alias("_whole_size"),
        F.min("_edge").alias("_first"),
        F.collect_list("_edge").alias("_edges"),
    )
    fixed = whole.select(F.explode("_edges").alias("_edge"), "_whole_keep", "_whole_size", "_first")
    return runs.join(F.broadcast(fixed), "_edge", "left")


def duplicates(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, keep_id (largest id with that text), group_size, kept, text_sha256."""
    all_ = _joined(sorted_runs(df, id, text))
    edge = F.col("_first").isNotNull()
    return all_.select(
        F.col("_id").alias(id),
        F.when(edge, F.col("_whole_keep")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_whole_size", "_size").alias("group_size"),
        (F.col("_head") & (~edge | (F.col("_edge") == F.col("_first")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def survivors(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with the columns of ``df``."""
    heads = _joined(sorted_runs(df, id, text, carry=True))
    stays = heads.where(F.col("_first").isNull() | (F.col("_edge") == F.col("_first")))
    return stays.select(*(F.col(f"_c{i}") for i in range(len(df.columns)))).toDF(*df.columns)
