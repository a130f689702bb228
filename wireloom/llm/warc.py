"""WARC archives and their capture index by external merge.

Writing: one record per capture, through Spark's own text writer (a record is text, and the writer's line
separator is the two CRLFs that end a record), so any file system Spark knows will do.  Of captures with
equal payloads the one with the largest id is a response and the others are revisits that refer to it.

Reading: each archive file is parsed by the records' Content-Length, payload digests of responses are
computed again, and its captures are sorted by (URL key, timestamp, id): a run.  Spark range-partitions all
runs by that key with sampled splitters, so a URL with any number of captures spreads over partitions, and
in each partition a loser tree merges the slices of all runs.  Partitions in order are the global index.

Defined results: a null payload is empty; a null url has an empty key and no target line; control characters
and blanks in a url are percent-encoded; a null id is kept and is never referred to unless its payload has no
other id; rows that repeat the response's id are responses as well.  Equal keys stay in id order.  Long payloads
share a file with fewer others, so that no file is much over ``FILE_BYTES`` unless one record is; an empty table
has no captures; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm.common import ROWS_PER_BATCH, new_path, ready, sized_broadcast, stage

#: Records and bytes of payloads of one archive file; a file is parsed in memory.
RECORDS_PER_FILE = 1000
FILE_BYTES = 64 << 20
#: Records of one class of sizes are up to this many times as long as those of the class before.
CLASS_STEP = 8
#: Rows of one range of keys, which one task merges in memory.
ROWS_PER_RANGE = 200_000
#: Rows of the merged index handed on at once.
ROWS_OUT = 10_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:capture:"
_RUN = (
    "run string, seq int, urlkey string, timestamp string, id bigint, record_type string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, url string, offset bigint, length bigint"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 5 hex digits are 4 letters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _safe(url: Column) -> Column:
    """No character that ends a header line or a field of the index."""
    return F.regexp_replace(F.regexp_replace(url, r"\x20", "%20"), r"[\x00-\x1F\x7F]", "%00")


def with_types(df: DataFrame, minimum: int = 0) -> DataFrame:
    """Captures (id, url, payload, time) with digest, record_type and refers_to."""
    rows = df.select("id", "url", F.encode(F.coalesce("payload", F.lit("")), "UTF-8").alias("payload"), "time")
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("digest"))
    groups = rows.where(F.col("size") >= minimum).groupBy("digest", "size")
    copies = groups.agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = stage(copies, "equal-payloads")
    joined = rows.join(sized_broadcast(copies), ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select(
        "id", "url", "payload", "time", "size", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record(df: DataFrame) -> Column:
    """The text of a record without the CRLFs that end it."""

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def uri(id: Column) -> Column:
        return F.concat(F.lit(f"<{_ID}"), id.cast("string"), F.lit(">"))

    answer = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.col("size").cast("string")),
        F.lit("\r\n"),
    )
    block = F.when(F.col("record_type") == "revisit", answer).otherwise(F.concat(answer, F.decode("payload", "UTF-8")))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", uri(F.coalesce(F.col("id").cast("string"), F.lit("")))),
        line("WARC-Date", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", _safe(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", uri(F.col("refers_to"))),
        line("WARC-Profile", F.when(F.col("record_type") == "revisit", PROFILE)),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(df: DataFrame, path: str) -> None:
    """Captures (id, url, payload, time) to WARC files in a new folder."""
    rows = with_types(df)
    # Payloads are dealt into classes by size, and a class puts as many into a file as fit whatever their sizes.
    number, limit, step = F.lit(0), FILE_BYTES // RECORDS_PER_FILE, 0
    limits = [limit]
    while limit < FILE_BYTES:
        number = F.when(F.col("size") > limit, step + 1).otherwise(number)
        limit, step = limit * CLASS_STEP, step + 1
        limits.append(limit)
    sized = rows.withColumn("class", number)
    sizes = df.select(F.coalesce(F.octet_length("payload"), F.lit(0)).alias("size"))
    found = sizes.select(number.alias("class")).distinct().collect()
    for c in sorted(r[0] for r in found) or [0]:
        text = sized.where(F.col("class") == c).select(record(rows).alias("value"))
        writer = text.write.mode("append").option("lineSep", END)
        writer.option("maxRecordsPerFile", max(min(FILE_BYTES // limits[c], RECORDS_PER_FILE), 1)).text(path)


def url_key(url: str) -> str:
    """Host labels from the right, then the rest as it is: captures of a site are neighbours."""
    scheme, found, rest = url.partition("://")
    at = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, _, port = rest[:at].lower().partition(":")
    if not found or not host:
        return url
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + rest[at:].partition("#")[0]


def parse(archive: bytes) -> Iterator[tuple]:
    """Rows of the index behind run and seq, in file order."""
    at = 0
    while at < len(archive):
        head_end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:head_end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        start = head_end + 4
        block = memoryview(archive)[start : start + int(head["Content-Length"])]
        own = archive.index(b"\r\n\r\n", start) + 4 - start
        answer = dict(x.split(": ", 1) for x in bytes(block[:own]).decode().split("\r\n")[1:] if x)
        kind, told = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(answer["Content-Length"])
        if kind == "response":
            payload = block[own:]
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest != told or len(payload) != size:
                raise ValueError(f"the payload at byte {at} is not what its record says")
        length = start + len(block) + 4 - at
        url = head.get("WARC-Target-URI")
        stamp = "".join(c for c in head["WARC-Date"] if c.isdigit())
        yield url_key(url or ""), stamp, _id(head["WARC-Record-ID"]), kind, _id(head.get("WARC-Refers-To")), size, told, url, at, length
        at += length


def _id(uri: str | None) -> int | None:
    digits = uri[1:-1].removeprefix(_ID) if uri else ""
    return int(digits) if digits else None


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = sorted(parse(content.as_py()), key=_order)
            if rows:
                name = path.as_py().rpartition("/")[2]
                columns = [[name] * len(rows), range(len(rows)), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA
                )


_SCHEMA = pa.schema([
    ("run", pa.string()), ("seq", pa.int32()), ("urlkey", pa.string()), ("timestamp", pa.string()),
    ("id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("url", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])


class LoserTree:
    """Merges sorted sequences: inner nodes hold the loser of their match, so the next winner costs one path."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = len(runs)
        self.losers = [-1] * self.k
        self.winner = -1
        for leaf in range(self.k):
            self._play(leaf, build=True)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; ended runs come last, ties go to the lower run."""
        x, y = self.at[a] < len(self.runs[a]), self.at[b] < len(self.runs[b])
        if not (x and y):
            return x if x != y else a < b
        left, right = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return (left, a) < (right, b)

    def _play(self, leaf: int, build: bool = False) -> None:
        node, now = (leaf + self.k) // 2, leaf
        while node > 0:
            other = self.losers[node]
            if other < 0 and build:
                self.losers[node] = now
                return
            if other >= 0 and self._less(other, now):
                self.losers[node], now = now, other
            node //= 2
        self.winner = now

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place) of every item in order."""
        while self.k and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            self._play(run)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of keys: rows come run by run, each in its own order; the range bounds what is held."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    keys = list(map(_order, zip(*(table[c].to_pylist() for c in ("urlkey", "timestamp", "id")), strict=True)))
    names = table["run"].to_pylist()
    starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
    ends = [*starts[1:], len(names)]
    order = (starts[run] + place for run, place in LoserTree([keys[a:b] for a, b in zip(starts, ends, strict=True)]))
    part: list[int] = []
    for i in order:
        part.append(i)
        if len(part) == ROWS_OUT:
            yield from table.take(pa.array(part)).to_batches()
            part = []
    if part:
        yield from table.take(pa.array(part)).to_batches()


def read_index(spark, path: str) -> DataFrame:
    """The index of all archives in a folder, partitions and rows in global order."""
    ready(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(limit, "1")  # a row is a whole archive file
    try:
        runs = stage(files.mapInArrow(_runs, _RUN), "capture-runs")
    finally:
        spark.conf.set(limit, str(ROWS_PER_BATCH))
    parts = max(-(-runs.count() // ROWS_PER_RANGE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = runs.repartitionByRange(parts, "urlkey", "timestamp", F.col("id").asc_nulls_first(), "run", "seq")
    return placed.sortWithinPartitions("run", "seq").mapInArrow(_merge, _RUN)


def archived(df: DataFrame) -> DataFrame:
    """Write captures (id, url, payload, time) as archives in the shared folder and read their index back."""
    spark = ready(df.sparkSession)
    path = new_path(spark, "archives")
    write_archives(df, path)
    return read_index(spark, path)
