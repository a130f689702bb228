from __future__ import annotations

import random
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wireloom.operators import decode
from wireloom.sources import capture, tables
from wireloom.streaming import ingest


def capture_bytes(records, magic=b"\xd4\xc3\xb2\xa1", order="<", unit=1):
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, 1)
    for t, r in records:
        out += struct.pack(order + "IIII", t // 10**6, t % 10**6 * unit, len(r), len(r) + 3) + r
    return out


def make_records(seed, n, evil=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 90)))
        if evil and i % 3 == 0:
            # A payload that is itself a long run of valid records.
            body = capture_bytes([(5_000_000 + k, b"z" * 9) for k in range(60)])[24:]
        out.append((1_700_000_000_000_000 + i * 777, body))
    return out


@pytest.mark.parametrize("evil", [False, True])
@pytest.mark.parametrize("range_bytes", [200, 1000, 1 << 30])
def test_ranges_read_every_record_once(spark, tmp_path, evil, range_bytes):
    files = {"a.pcap": make_records(1, 150, evil), "b.pcap": make_records(2, 40, evil)}
    for name, records in files.items():
        (tmp_path / name).write_bytes(capture_bytes(records))
    if range_bytes == 200 and evil:
        range_bytes = 700
    df = capture.read_captures(spark, str(tmp_path), range_bytes)
    got = sorted((r["t"], bytes(r["r"])) for r in df.collect())
    assert got == sorted(files["a.pcap"] + files["b.pcap"])
    assert df.select("rowkey").distinct().count() == len(got)
    if range_bytes < 1 << 30:
        assert len(capture.plan_ranges(spark, str(tmp_path), range_bytes)) > 4


def test_small_ranges_read_their_own_bytes_in_few_tasks(spark, tmp_path, monkeypatch):
    """Each range of a megabyte read several, in a task of its own."""
    path = str(tmp_path / "a.pcap")
    (tmp_path / "a.pcap").write_bytes(capture_bytes(make_records(4, 20_000)))
    ranges, size = capture.plan_ranges(spark, path, 10_000), (tmp_path / "a.pcap").stat().st_size
    assert len(ranges) > 100
    monkeypatch.setattr(capture, "TASK_BYTES", 1)
    assert capture._slices(spark, 3, 10**9) == 3 and capture._slices(spark, 10**6, 100) == max(100, 4 * 8)
    monkeypatch.undo()
    assert capture.read_captures(spark, path, 10_000).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    read = []

    class Counted:
        def __init__(self, file):
            self.file = file

        def read_at(self, n, at):
            data = self.file.read_at(n, at)
            read.append(len(data))
            return data

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    real = capture._open
    monkeypatch.setattr(capture, "_open", lambda name: Counted(real(name)))
    assert sum(len(places) for r in ranges for places, *_ in capture.records(r)) == 20_000
    assert sum(read) < 1.5 * size
    read.clear()
    cuts = [(path, at, min(at + 100_000, size), size) for at in range(0, size, 100_000)]
    assert [capture._index_range(*c)[3] for c in cuts][-1] == size
    assert sum(read) < 2 * size


def test_layouts_and_cut_off_files(spark, tmp_path):
    records = make_records(3, 30)
    whole = capture_bytes(records)
    (tmp_path / "big.pcap").write_bytes(capture_bytes(records, b"\xa1\xb2\xc3\xd4", ">"))
    (tmp_path / "nano.pcap").write_bytes(capture_bytes(records, b"\x4d\x3c\xb2\xa1", "<", 1000))
    (tmp_path / "cut.pcap").write_bytes(whole[:-1])
    (tmp_path / "bare.pcap").write_bytes(whole[:24])
    for name, snap in (("huge", b"\xff\xff\xff\xff"), ("large", b"\xff\xff\xff\x7f")):
        (tmp_path / f"{name}.pcap").write_bytes(whole[:16] + snap + whole[20:])
    for name, expected in (("huge", 30), ("large", 30), ("big", 30), ("nano", 30), ("cut", 29), ("bare", 0)):
        got = capture.read_captures(spark, str(tmp_path / f"{name}.pcap"), 300).collect()
        assert sorted((r["t"], bytes(r["r"])) for r in got) == records[:expected], name


def test_format_name(spark, tmp_path):
    records = make_records(4, 20)
    (tmp_path / "x.pcap").write_bytes(capture_bytes(records))
    capture.register(spark)
    df = spark.read.format("capture").load(str(tmp_path))
    assert sorted((r["t"], bytes(r["r"])) for r in df.collect()) == records
    assert [f.name for f in df.schema] == ["rowkey", "t", "r"]


def loaded(spark, path, **options):
    capture.register(spark)
    return spark.read.format("capture").options(**options).load(str(path))


@pytest.mark.parametrize("indexed", [False, True])
def test_the_format_splits_a_file_and_skips_ranges_by_time(spark, tmp_path, indexed):
    records = make_records(6, 400, evil=True)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pcap").write_bytes(capture_bytes(records))
    options = {"rangeBytes": "9000"}
    if indexed:
        capture.write_index(spark, str(tmp_path / "in"), str(tmp_path / "index"), 9000)
        options = {"index": str(tmp_path / "index")}
    df = loaded(spark, tmp_path / "in", **options)
    assert df.rdd.getNumPartitions() > 20
    assert sorted((r["t"], bytes(r["r"])) for r in df.collect()) == records
    plain = capture.read_captures(spark, str(tmp_path / "in"), 1 << 30)
    assert sorted(map(bytes, (r.rowkey for r in plain.collect()))) == sorted(map(bytes, (r.rowkey for r in df.collect())))
    first, last = records[100][0], records[120][0]
    few = df.where(f"t >= {first} and t < {last}")
    assert 1 <= few.rdd.getNumPartitions() <= 4
    assert sorted((r["t"], bytes(r["r"])) for r in few.collect()) == records[100:120]
    assert [r["t"] for r in df.where(f"t = {first}").collect()] == [first]
    assert df.where("t > 9000000000000000").count() == 0 and df.where("t < 5").count() == 0


def test_a_stream_of_growing_captures_equals_the_batch(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    capture.register(spark)
    a, b = capture_bytes(make_records(7, 60, evil=True)), capture_bytes(make_records(8, 30))

    def drain():
        stream = spark.readStream.format("capture").load(str(folder))
        ingest.write_stream(stream, out, mark, None).awaitTermination()
        return sorted((bytes(r.rowkey), r.t, bytes(r.r)) for r in spark.read.parquet(out).collect())

    def batch():
        return sorted((bytes(r.rowkey), r.t, bytes(r.r)) for r in capture.read_captures(spark, str(folder)).collect())

    # The first file is cut in the middle of a record, then goes on; a second one comes later.
    (folder / "a.pcap").write_bytes(a[: len(a) // 2])
    assert drain() == batch() != []
    assert drain() == batch()
    (folder / "a.pcap").write_bytes(a)
    (folder / "b.pcap").write_bytes(b[:20])
    assert len(drain()) == 60
    (folder / "b.pcap").write_bytes(b)
    assert drain() == batch() and len(batch()) == 90


def test_row_keys_do_not_depend_on_ranges(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(capture_bytes(make_records(5, 80)))
    path = str(tmp_path / "x.pcap")
    keys = [
        sorted(bytes(r["rowkey"]) for r in capture.read_captures(spark, path, n).collect())
        for n in (400, 1 << 30)
    ]
    assert keys[0] == keys[1]


def test_merge_by_key(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "rowkey int, x string")
    one = spark.createDataFrame([(1, 10), (9, 90)], "rowkey int, y int")
    two = spark.createDataFrame([(2, "B"), (3, "C")], "rowkey int, x string")
    got = sorted(tuple(r) for r in tables.merge_by_key(base, one, two).collect())
    assert got == [(1, "a", 10), (2, "B", None), (3, "C", None)]


def test_write_read_and_pushdown(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(bytes([i]), i, "x") for i in range(20)], "k binary, n int, s string")
    tables.write(df, path, ["k", "n"])
    back = tables.scan(spark, path, ["n"])
    assert back.columns == ["n"] and back.count() == 20
    one = tables.with_key(tables.scan(spark, path), "k", "0a")
    assert [r["n"] for r in one.collect()] == [10]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k" in plan.split("PushedFilters")[1]


def test_write_records(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.range(100).select(
        F.col("id").cast("string").alias("key"), F.concat("id", F.lit("hello")).alias("r")
    )
    tables.write_records(
        tables.with_literal(tables.with_prefix(df, "r", "1"), "p", b"\x01"), path, regions=5
    )
    back = tables.scan(spark, path, schema=tables.CATALOG_RECORDS)
    assert back.count() == 11 and bytes(back.first()["p"]) == b"\x01"
    assert 1 <= len(list((tmp_path / "r").glob("*.parquet"))) <= 5


def test_preview(spark):
    df = spark.createDataFrame([(b"\x02", b"\x0a\xff"), (b"\x01", b"\x00")], "k binary, r binary")
    assert [tuple(r) for r in tables.preview(df, "k", "r", 2).collect()] == [
        ("1", "0"), ("2", "a ff"),
    ]


def test_stream_equals_batch_and_restart_adds_nothing(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "key binary, value binary, partition int, offset bigint"

    def add(first):
        rows = [((7).to_bytes(8, "big"), bytes([i]), 0, i) for i in range(first, first + 10)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)

    def drain():
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.write_stream(ingest.raw_packets(stream), sink, mark, None).awaitTermination()
        return spark.read.parquet(sink)

    add(0)
    assert drain().count() == 10
    assert drain().count() == 10
    add(10)
    got = drain()
    batch = ingest.raw_packets(spark.read.schema(schema).parquet(source))
    assert sorted(got.collect()) == sorted(batch.collect())
    # Equal times stay apart.
    assert got.select("rowkey").distinct().count() == 20
    assert {r["t"] for r in got.collect()} == {7}


@pytest.mark.parametrize("most", [1 << 30, 300_000, 1])
def test_captures_of_a_round_are_gone_before_the_next(spark, sf, monkeypatch, most):
    """All frames lay in the shared folder as captures, which are not compressed, for as long as the result was read."""
    import checks.fixtures as fx
    from checks.queries import QUERIES

    monkeypatch.setattr(fx, "CAPTURE_BYTES", most)
    monkeypatch.setattr(fx, "_TABLES", {})
    stored = fx.stored
    monkeypatch.setattr(fx, "stored", lambda s, d, n, build, *_: stored(s, d, n, build, 1_000))
    frames, write, folders = fx.frame_table(spark, sf), fx.write_captures, []

    def watched(some, path):
        write(some, path)
        folders.append(Path(path))
        held = [sum(f.stat().st_size for f in folder.glob("*.pcap")) for folder in folders]
        assert not any(held[:-1]) and (some.count() <= 1_000 or held[-1] <= most + 24 * len(list(folders[-1].glob("*.pcap"))))

    monkeypatch.setattr(fx, "write_captures", watched)
    got = QUERIES["s2_capture_ingest"](spark, sf)
    assert len(folders) == 1 if most == 1 << 30 else len(folders) > 3
    assert not any(list(folder.glob("*.pcap")) for folder in folders)
    whole = decode.decoded_packets(frames).select(*got.columns)
    assert got.count() == frames.count() and got.exceptAll(whole).isEmpty()


def test_streamed_tables_are_compact(spark, tmp_path):
    schema = "key binary, value binary, partition int, offset bigint"
    rows = [(i.to_bytes(8, "big"), b"abc" * 9, 0, i) for i in range(50)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.raw_packets(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    ingest.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "mark"), None).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    assert [f.name.endswith(".zstd.parquet") for f in (tmp_path / "out").glob("*.parquet")] == [True]
