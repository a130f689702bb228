"""Helpers the operators of this folder share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.plans.staging import new_path, stage

__all__ = [
    "UPPER", "LOWER", "BROADCAST_ROWS", "lower_ascii", "new_path", "ready", "sized_broadcast",
    "slices", "stage", "unused", "utf8",
]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows of text handed to Python at once.
ROWS_PER_BATCH = 1000

#: A side of narrow rows is broadcast when it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20

#: Bytes of text a vectorised step works on at once; one longer text is a step of its own.
SLICE_BYTES = 1 << 20


_sent: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, and keep batches of text small.

    The default of 10,000 rows a batch can be gigabytes of long documents.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    context = spark.sparkContext
    if context.applicationId not in _sent:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="wireloom-"), "wireloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        whole = os.path.join(folder, name)
                        z.write(whole, os.path.relpath(whole, os.path.dirname(package)))
        context.addPyFile(path)
        _sent.add(context.applicationId)
    return spark


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def sized_broadcast(
    staged: DataFrame, most: int = BROADCAST_ROWS, size: Column | None = None
) -> DataFrame:
    """``staged`` (a written table) with a broadcast hint if it was found to be small.

    Small is at most ``most`` rows and, where rows vary in ``size`` bytes, ``BROADCAST_BYTES`` together.
    Beyond that Spark joins by a shuffle, whose hot keys adaptive execution splits.
    """
    rows, total = staged.agg(F.count(F.lit(1)), F.sum(F.lit(0) if size is None else size)).first()
    return F.broadcast(staged) if rows <= most and (total or 0) <= BROADCAST_BYTES else staged


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and each row's offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if len(offsets) else whole[:0], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``most`` bytes together, at least one row each."""
    if not len(column):
        return
    offsets = utf8(column)[1]
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop
        start = stop
