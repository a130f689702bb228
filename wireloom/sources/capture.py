"""Capture files (the classic ``pcap`` format) as a Spark data source.

``spark.read.format("capture").load(folder)`` yields raw packets ``(rowkey, t, r)``, and so does
``spark.readStream`` of a folder whose files grow and become more.

Files are cut into byte ranges, so that one large file does not become one task.
The format has no sync marks, so each range looks for a chain of plausible record headers; the index
then walks the headers of every range and checks that each range ends exactly where the next one
begins, and repairs those that do not.  What is read is exactly the record sequence of the file.

The walk also notes the first and last time of a range, so that a filter on ``t`` leaves out ranges.  It runs as
Spark tasks in ``write_index`` and ``read_captures``; the format takes a written index as option ``index``, and
without one walks itself, where the query is planned.  A stream walks what is new there, as far as whole records go.
"""

from __future__ import annotations

import hashlib
import struct
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from wireloom.functions.binary import fixed_width, md5_bytes
from wireloom.sources.tables import RAW_PACKETS

# Fixed values of the file format.
FILE_HEADER = 24
RECORD_HEADER = 16
MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1),
    b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\x3c\x4d": (">", 1000),
}
LONGEST_RECORD = 262144

#: Bytes of one range.
RANGE_BYTES = 256 * 1024 * 1024

#: Record headers that must follow each other before a position counts as a record.
CHAIN = 24

#: Bytes in which a range first looks for its first record, and bytes of ranges that one task reads at least.
LOOK_BYTES = 64 * 1024
TASK_BYTES = 64 * 1024 * 1024

BATCH_ROWS = 4096
BATCH_BYTES = 8 * 1024 * 1024
WALK_BYTES = 4 * 1024 * 1024


@dataclass
class Layout:
    """Byte order, sub-second unit and longest record of a file."""

    order: str
    unit: int
    longest: int


@dataclass
class FileRange(InputPartition):
    """Records of ``path`` that start in ``[start, end)``, both record boundaries; the least and greatest of their times."""

    path: str
    start: int
    end: int
    low: int | None = None
    high: int | None = None


def _open(path: str):
    files, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return files.open_input_file(name)


def _layout(file) -> Layout:
    header = file.read_at(FILE_HEADER, 0)
    if len(header) < FILE_HEADER or header[:4] not in MAGIC:
        raise ValueError("not a capture file")
    order, unit = MAGIC[header[:4]]
    longest = struct.unpack_from(order + "I", header, 16)[0]
    # Some writers put 2^31 - 1 or more there; it only bounds where a range looks for its first record.
    return Layout(order, unit, min(longest or LONGEST_RECORD, LONGEST_RECORD))


def _chain_holds(data: bytes, at: int, layout: Layout, ends_file: bool, whole: bool = True) -> bool | None:
    """Whether plausible records follow one another from ``at``; None where only more than this part of the ``whole`` data can tell."""
    for _ in range(CHAIN):
        if at == len(data) and ends_file:
            return True
        if at + RECORD_HEADER > len(data):
            return False if whole else None
        _, frac, kept, length = struct.unpack_from(layout.order + "IIII", data, at)
        if frac >= 1_000_000 * layout.unit or not 0 < kept <= min(length, layout.longest):
            return False
        at += RECORD_HEADER + kept
    return True


def _first_record(file, at: int, size: int, layout: Layout) -> int:
    """Position of the first record at or after ``at`` as far as headers can tell."""
    if at <= FILE_HEADER:
        return FILE_HEADER
    window = min((CHAIN + 1) * (RECORD_HEADER + layout.longest), size - at)
    offset, held = 0, min(LOOK_BYTES, window)
    while True:
        data, whole = file.read_at(held, at), held == window
        ends_file = at + len(data) == size
        while offset < len(data):
            holds = _chain_holds(data, offset, layout, ends_file, whole)
            if holds:
                return at + offset
            if holds is None:
                break  # looked at again with more data
            offset += 1
        if whole:
            return size
        held = min(4 * held, window)


@dataclass
class Walked:
    """Where a walk came to, the end of its last whole record, and the times of its records."""

    end: int
    whole: int
    low: int | None = None
    high: int | None = None


def _walk(file, at: int, stop: int, size: int, layout: Layout) -> Walked:
    """Follow record headers from ``at`` to the first record at or after ``stop``."""
    block, origin, low, high = b"", at, None, None
    while at < stop:
        if at + RECORD_HEADER > size:
            return Walked(size, at, low, high)
        if at + RECORD_HEADER > origin + len(block):
            # The last record of a range may begin at its last byte.
            block, origin = file.read_at(min(WALK_BYTES, stop + RECORD_HEADER - at, size - at), at), at
        sec, frac, kept = struct.unpack_from(layout.order + "III", block, at - origin)
        if at + RECORD_HEADER + kept > size:
            return Walked(size, at, low, high)  # cut off in the middle of a record
        t = sec * 1_000_000 + frac // layout.unit
        low, high = (t, t) if low is None else (min(low, t), max(high, t))
        at += RECORD_HEADER + kept
    return Walked(at, at, low, high)


def _list_files(path: str) -> list[tuple[str, int]]:
    files, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    info = files.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = files.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File)


_INDEX = "path string, at long, begin long, end long, low long, high long"


def _index_range(
    path: str, at: int, stop: int, size: int, begin: int | None = None
) -> tuple[str, int, int, int, int | None, int | None]:
    with _open(path) as file:
        layout = _layout(file)
        if begin is None:
            begin = _first_record(file, at, size, layout)
        walked = _walk(file, begin, stop, size, layout)
        return path, at, begin, walked.end, walked.low, walked.high


def plan_ranges(
    spark: SparkSession | None, path: str, range_bytes: int = RANGE_BYTES
) -> list[FileRange]:
    """Record-aligned ranges of all files; header walks run as Spark tasks when there are many.

    One small row per range comes back.  A range whose begin is not the end of the one before (a payload
    that looked like records) is walked again, in a task, from the true boundary.  Without a session the walks
    are threads of this process.
    """
    cuts = [
        (name, at, min(at + range_bytes, size), size)
        for name, size in _list_files(path)
        if size > FILE_HEADER
        for at in range(0, size, range_bytes)
    ]
    found = {(p, at): rest for p, at, *rest in _indexed(spark, cuts)}
    while True:
        ranges, again = [], []
        previous: tuple[str, int] | None = None
        broken = None
        for name, at, stop, size in cuts:
            begin, end, low, high = found[(name, at)]
            if previous and previous[0] == name and begin != previous[1] and broken != name:
                # The file is walked on from here; what follows is judged in the next round.
                again.append((name, at, stop, size, previous[1]))
                broken = name
            previous = (name, end)
            if begin < end:
                ranges.append(FileRange(name, begin, end, low, high))
        if not again:
            return ranges
        found |= {(p, at): rest for p, at, *rest in _indexed(spark, again)}


def _indexed(spark: SparkSession | None, cuts: list[tuple]) -> list[tuple]:
    """(path, at, begin, end, low, high) of cuts; a fifth value is the known first record."""
    if not cuts:
        return []
    if len(cuts) == 1:
        return [_index_range(*cuts[0])]
    if spark is None:
        with ThreadPoolExecutor(8) as threads:
            return list(threads.map(lambda cut: _index_range(*cut), cuts))
    rows = [(*c, None)[:5] for c in cuts]
    schema = "path string, at long, stop long, size long, begin long"
    slices = _slices(spark, len(rows), sum(stop - at for _, at, stop, *_ in cuts))
    todo = spark.createDataFrame(spark.sparkContext.parallelize(rows, slices), schema)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_index_range(**r) for r in batch.to_pylist()]
            columns = list(zip(*done, strict=True)) or [[]] * 6
            kinds = [pa.string(), *[pa.int64()] * 5]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["path", "at", "begin", "end", "low", "high"])

    return [tuple(r) for r in todo.mapInArrow(index, _INDEX).collect()]


def _slices(spark: SparkSession, ranges: int, size: int) -> int:
    """Tasks for so many ranges, which lie side by side in them: all cores have some, then each task has ``TASK_BYTES``."""
    return max(1, min(ranges, max(4 * spark.sparkContext.defaultParallelism, size // TASK_BYTES)))


def write_index(spark: SparkSession, path: str, index: str, range_bytes: int = RANGE_BYTES) -> None:
    """The ranges of all files under ``path`` as a table, for the option ``index`` of the format."""
    rows = [(r.path, r.start, r.end, r.low, r.high) for r in plan_ranges(spark, path, range_bytes)]
    table = spark.createDataFrame(rows, "path string, start long, end long, low long, high long")
    table.coalesce(1).write.mode("overwrite").parquet(index)


def _stored_index(index: str) -> list[FileRange]:
    files, name = fs.FileSystem.from_uri(index) if "://" in index else (fs.LocalFileSystem(), index)
    rows = ds.dataset(name, format="parquet", filesystem=files).to_table().to_pylist()
    return [FileRange(**r) for r in sorted(rows, key=lambda r: (r["path"], r["start"]))]


def records(part: FileRange) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Offsets, times and frames of one range in batches of bounded size; memory holds one batch."""
    with _open(part.path) as file:
        layout = _layout(file)
        places, times, frames = [], [], []
        held, at = 0, part.start
        block, origin = b"", at
        while at < part.end:
            if at + RECORD_HEADER > origin + len(block):
                block, origin = file.read_at(min(WALK_BYTES, part.end - at), at), at
                if len(block) < RECORD_HEADER:
                    break
            sec, frac, kept, _ = struct.unpack_from(layout.order + "IIII", block, at - origin)
            if at + RECORD_HEADER + kept > origin + len(block):
                block, origin = file.read_at(max(min(WALK_BYTES, part.end - at), RECORD_HEADER + kept), at), at
                if len(block) < RECORD_HEADER + kept:
                    break  # cut off in the middle of a record
            body = at - origin + RECORD_HEADER
            places.append(at)
            times.append(sec * 1_000_000 + frac // layout.unit)
            frames.append(block[body : body + kept])
            held += kept
            at += RECORD_HEADER + kept
            if len(places) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield places, times, frames
                places, times, frames, held = [], [], [], 0
        if places:
            yield places, times, frames


def read_range(part: FileRange) -> Iterator[pa.RecordBatch]:
    """Raw packets of one range.  The row key is the digest of the time and half of that of file and offset."""
    name = part.path.encode()
    for places, times, frames in records(part):
        keys = [
            hashlib.md5(t.to_bytes(8, "big")).digest() + hashlib.md5(name + at.to_bytes(8, "big")).digest()[:8]
            for at, t in zip(places, times, strict=True)
        ]
        arrays = [pa.array(keys, pa.binary()), pa.array(times, pa.int64()), pa.array(frames, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["rowkey", "t", "r"])


class CaptureReader(DataSourceReader):
    """Ranges of all files, from a written index or a walk of its own, without those no filter on ``t`` lets through."""

    def __init__(self, path: str, index: str | None, range_bytes: int) -> None:
        self.path, self.index, self.range_bytes = path, index, range_bytes
        self.low, self.high = -(1 << 63), (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("t",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value)
            yield f  # a range may hold other times as well

    def partitions(self) -> list[FileRange]:
        ranges = _stored_index(self.index) if self.index else plan_ranges(None, self.path, self.range_bytes)
        kept = [r for r in ranges if r.low is not None and r.low <= self.high and r.high >= self.low]
        # A scan needs a partition; an empty range gives no rows.
        return kept or [FileRange("", 0, 0)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition) if partition.end > partition.start else iter(())


class CaptureStream(DataSourceStreamReader):
    """Records that were added to the files of a folder; an offset is the end of the last whole record of each file."""

    def __init__(self, path: str) -> None:
        self.path, self.ends = path, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for name, size in _list_files(self.path):
            at = self.ends.get(name, FILE_HEADER)
            if size > at:
                with _open(name) as file:
                    self.ends[name] = _walk(file, at, size, size, _layout(file)).whole
        return dict(self.ends)

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        new = [FileRange(name, start.get(name, FILE_HEADER), stop) for name, stop in sorted(end.items())]
        return [r for r in new if r.start < r.end]

    def commit(self, end: dict) -> None:
        # After a restart the walk goes on from what the checkpoint has.
        self.ends = {**end, **{k: v for k, v in self.ends.items() if v > end.get(k, 0)}}

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


class CaptureSource(DataSource):
    """Format name ``capture``; options ``path``, ``index`` and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> StructType:
        return RAW_PACKETS

    def reader(self, schema: StructType) -> CaptureReader:
        range_bytes = int(self.options.get("rangeBytes", RANGE_BYTES))
        return CaptureReader(self.options["path"], self.options.get("index"), range_bytes)

    def streamReader(self, schema: StructType) -> CaptureStream:
        return CaptureStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, which then hands filters to such sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CaptureSource)


def read_captures(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Raw packets of all capture files under ``path``, large files in parallel."""
    ranges = plan_ranges(spark, path, range_bytes)
    rows = [(r.path, r.start, r.end) for r in ranges]
    todo = spark.sparkContext.parallelize(rows, _slices(spark, len(rows), sum(r.end - r.start for r in ranges)))
    todo = spark.createDataFrame(todo, "path string, start long, end long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for places, times, frames in records(FileRange(row["path"], row["start"], row["end"])):
                    paths = pa.array([row["path"]] * len(places))
                    arrays = [paths, pa.array(places, pa.int64()), pa.array(times, pa.int64()), pa.array(frames, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["path", "at", "t", "r"])

    raw = todo.mapInArrow(read, "path string, at long, t long, r binary")
    place = md5_bytes(F.concat(F.col("path").cast("binary"), fixed_width(F.col("at"), 8)))
    key = F.concat(md5_bytes(fixed_width(F.col("t"), 8)), F.substring(place, 1, 8))
    return raw.select(key.alias("rowkey"), "t", "r")
