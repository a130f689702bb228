from __future__ import annotations

import random
import time

import pytest
from conftest import plan_text
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import checks.fixtures as fx
from checks.queries import QUERIES
from wireloom.functions.binary import md5_bytes
from wireloom.plans import staging
from wireloom.sources import tables
from wireloom.sources.keyed import PREFIX, KeyedTable
from wireloom.streaming import ingest

SCHEMA = StructType().add("rowkey", "long").add("a", "integer").add("b", "string")


def rows(table, spark):
    return sorted((tuple(r) for r in table.read(spark).collect()), key=repr)


def slow(batches):
    """Batches of dicts put one after the other; of equal keys in a batch the greatest counts."""
    out = {}
    for batch in batches:
        best = {}
        for k, a, b in batch:
            rank = (a is not None, a or 0, b is not None, b or "")
            if k not in best or rank > best[k][0]:
                best[k] = rank, a, b
        for k, (_, a, b) in best.items():
            old = out.get(k, (None, None))
            out[k] = (old[0] if a is None else a, old[1] if b is None else b)
    return sorted(((k, *v) for k, v in out.items()), key=repr)


@pytest.mark.parametrize("prefixes", [1, 7, 64])
def test_upserts_against_a_dictionary(spark, tmp_path, prefixes):
    rng = random.Random(prefixes)
    table = KeyedTable(str(tmp_path / "t"), SCHEMA, prefixes=prefixes).create(spark)
    assert rows(table, spark) == []
    batches = []
    for size in (40, 3, 0, 25):
        keys = [None, *range(50)]
        batches.append([(rng.choice(keys), rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y", ""])) for _ in range(size)])
        table.upsert(spark.createDataFrame(batches[-1], SCHEMA))
        assert rows(table, spark) == slow(batches)
    table.create(spark)
    assert rows(table, spark) == slow(batches)


def test_columns_that_are_not_given_stay(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), SCHEMA).create(spark)
    table.upsert(spark.createDataFrame([(1, 10), (2, 20)], "rowkey int, a int"))
    table.upsert(spark.createDataFrame([("x", 2), ("z", 3)], "b string, rowkey long"))
    table.upsert(spark.createDataFrame([(4,), (1,), (4,)], "rowkey long"))
    assert rows(table, spark) == [(1, 10, None), (2, 20, "x"), (3, None, "z"), (4, None, None)]
    with pytest.raises(ValueError, match="no columns"):
        table.upsert(spark.createDataFrame([(1, 1)], "rowkey long, c int"))


def test_a_batch_counts_once_and_can_be_finished(spark, tmp_path, monkeypatch):
    table = KeyedTable(str(tmp_path / "t"), SCHEMA, prefixes=4).create(spark)
    table.upsert(spark.createDataFrame([(i, i, "old") for i in range(20)], SCHEMA), "one")
    table.upsert(spark.createDataFrame([(i, -1, "again") for i in range(20)], SCHEMA), "one")
    assert {r[2] for r in rows(table, spark)} == {"old"}
    # The job dies after the merged rows were written, with a part of the table already gone.
    note = KeyedTable._note

    def dies(self, session, batch, step):
        note(self, session, batch, step)
        if step == "merged":
            raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, "_note", dies)
    update = spark.createDataFrame([(i, 100 + i, None) for i in range(5, 30)], SCHEMA)
    with pytest.raises(RuntimeError, match="lost"):
        table.upsert(update, "two")
    monkeypatch.setattr(KeyedTable, "_note", note)
    gone = next((tmp_path / "t" / "rows").glob(f"{PREFIX}=*"))
    for f in [*gone.glob("*.parquet"), *gone.glob(".*.crc")]:
        f.unlink()
    table.upsert(update, "two")
    table.upsert(update, "two")
    whole = [[(i, i, "old") for i in range(20)], [(i, 100 + i, None) for i in range(5, 30)]]
    touched = {r[0] for r in update.select(table._prefix(F.col("rowkey"))).distinct().collect()}
    assert int(gone.name.split("=")[1]) in touched
    assert rows(table, spark) == slow(whole)


def test_other_folders_are_neither_read_nor_written(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), SCHEMA, prefixes=16).create(spark)
    table.upsert(spark.createDataFrame([(i, i, "x") for i in range(500)], SCHEMA))
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "rows").rglob("*.parquet")}
    update = spark.createDataFrame([(7, 1, "y")], SCHEMA)
    own = update.select(table._prefix(F.col("rowkey"))).first()[0]
    plan = plan_text(table._merged(update))
    assert f"PartitionFilters: [isnotnull({PREFIX}" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    mine = table.read(spark).where(table._prefix(F.col("rowkey")) == own).count()
    assert scanned_rows(table._merged(update)) == mine + 1 < 100
    table.upsert(update)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "rows").rglob("*.parquet")}
    changed = set(after.items()) ^ set(files.items())
    assert changed and all(f.parent.name == f"{PREFIX}={own}" for f, _ in changed)


def test_a_batch_moves_rows_once_and_leaves_nothing_beside(spark, tmp_path):
    """Updates were dealt by key, then joined, then dealt by range, and stayed beside the table three times."""
    table = KeyedTable(str(tmp_path / "t"), SCHEMA, prefixes=4).create(spark)
    for value in ("x", "y"):
        table.upsert(spark.createDataFrame([(i % 900, i, value) for i in range(1000)], SCHEMA))
    assert rows(table, spark) == sorted(((i, i + 900 if i < 100 else i, "y") for i in range(900)), key=repr)
    assert plan_text(table._merged(spark.createDataFrame([(7, 1, "y")], SCHEMA))).count("Exchange") == 1
    beside = [spark.read.parquet(str(f)).count() for f in (tmp_path / "t" / "batches").iterdir()]
    assert len(beside) == 4 and sum(beside) == 0


def scanned_rows(df) -> int:
    """Rows that left the Parquet scan, by its own counter, after running the plan."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def keyed_rows(spark, n):
    return spark.range(n).select(md5_bytes(F.col("id").cast("string").cast("binary")).alias("rowkey"), F.col("id").alias("n"))


def test_a_look_up_reads_few_row_groups(spark, tmp_path):
    n, many = 40_000, keyed_rows(spark, 40_000)
    key = bytes(many.where("n = 12345").first()["rowkey"])
    tables.write(many.repartition(4), str(tmp_path / "plain"))
    one = spark.read.parquet(str(tmp_path / "plain")).where(F.col("rowkey") == key)
    assert [r.n for r in one.collect()] == [12345] and scanned_rows(one) > n / 2
    tables.write_clustered(many.repartition(4), str(tmp_path / "clustered"), row_group_bytes=1 << 16)
    one = spark.read.parquet(str(tmp_path / "clustered")).where(F.col("rowkey") == key)
    assert [r.n for r in one.collect()] == [12345] and scanned_rows(one) < n / 4
    table = KeyedTable(str(tmp_path / "keyed"), many.schema, prefixes=32).create(spark)
    table.upsert(many)
    one = table.lookup(spark, [key, b"absent"])
    assert [r.n for r in one.collect()] == [12345] and scanned_rows(one) < n / 8
    assert sorted(r.n for r in table.lookup_all(many.where("n % 999 = 0")).collect()) == list(range(0, n, 999))


def test_bloom_filters_skip_files_whose_range_holds_the_key(spark, tmp_path):
    """Files that all span the whole range of keys: only their filters tell that a key is not in them."""
    from wireloom.sources.keyed import clustered_writer

    many = keyed_rows(spark, 20_000).repartition(8, "n")
    # Keys are unique, so the writer gives up dictionaries.
    clustered_writer(many, "rowkey").parquet(str(tmp_path / "spread"))
    key = bytes(many.where("n = 77").first()["rowkey"])
    one = spark.read.parquet(str(tmp_path / "spread")).where(F.col("rowkey") == key)
    assert [r.n for r in one.collect()] == [77] and scanned_rows(one) <= 20_000 / 4


def test_merges_of_bucketed_tables_have_no_exchange(spark, sf):
    plan = plan_text(QUERIES["j6_bucketed_merge"](spark, sf))
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    assert "Exchange" in plan_text(QUERIES["j6_key_merge"](spark, sf))


def test_streams_put_each_key_once(spark, tmp_path, monkeypatch):
    schema = "key binary, value binary, partition int, offset bigint"
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    table = KeyedTable(str(tmp_path / "t"), tables.RAW_PACKETS, prefixes=8).create(spark)

    def add(first):
        some = [((7 + i).to_bytes(8, "big"), bytes([i]), 0, i) for i in range(first, first + 10)]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(source)

    def drain():
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.upsert_stream(ingest.raw_packets(stream), table, mark, interval=None).awaitTermination()

    add(0)
    drain()
    add(10)
    # The table is written, then the stream stops before it notes the batch.
    put = KeyedTable.upsert

    def stops(self, updates, batch=None):
        put(self, updates, batch)
        raise RuntimeError("stopped")

    monkeypatch.setattr(KeyedTable, "upsert", stops)
    with pytest.raises(Exception, match="stopped"):
        drain()
    assert table.read(spark).count() == 20
    monkeypatch.setattr(KeyedTable, "upsert", put)
    drain()
    batch = ingest.raw_packets(spark.read.schema(schema).parquet(source))
    assert sorted(table.read(spark).collect()) == sorted(batch.collect()) and batch.count() == 20


def test_fixture_is_built_once(spark, sf):
    assert fx.keyed_sessions(spark, sf).path == fx.keyed_sessions(spark, sf).path


@pytest.mark.parametrize("dies_at", [None, ("merged", 2), ("done", 2)])
def test_a_large_batch_is_put_in_rounds(spark, tmp_path, monkeypatch, dies_at):
    """All of a batch lay merged beside the table, and all of its shuffles, before any of it was put in place."""
    table = KeyedTable(str(tmp_path / "t"), SCHEMA, prefixes=3).create(spark)
    batches = [[(i, i, "old") for i in range(60)], [(i, 100 + i, None) for i in range(40, 90)]]
    table.upsert(spark.createDataFrame(batches[0], SCHEMA), "one")
    monkeypatch.setattr(staging, "ROUND_BYTES", 1)
    beside, seen, note = tmp_path / "t" / "batches", [], KeyedTable._note

    def watched(self, session, batch, step):
        note(self, session, batch, step)
        seen.append(step)
        if step == "merged":
            merged = [n for f in beside.glob("two-*of*") if (n := session.read.parquet(str(f)).count())]
            assert len(merged) == 1 and merged[0] < 60
        if dies_at and seen.count(dies_at[0]) == dies_at[1] and step == dies_at[0]:
            raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, "_note", watched)
    update = spark.createDataFrame(batches[1], SCHEMA)
    if dies_at:
        with pytest.raises(RuntimeError, match="lost"):
            table.upsert(update, "two")
        seen.append("again")
        monkeypatch.setattr(staging, "ROUND_BYTES", 1 << 30)  # a batch goes on in the rounds it began with
    for _ in range(2):
        table.upsert(update, "two")
    assert rows(table, spark) == slow(batches)
    assert seen.count("rounds 3") == 1 and seen.count("merged") == 3
    assert sum(spark.read.parquet(str(f)).count() for f in beside.glob("two-*of*")) == 0
    assert spark.read.parquet(str(beside / "two-updates")).count() == 0


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_puts_and_stages_leave_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    many = keyed_rows(spark, 1000)
    assert staging.stage(many.groupBy(F.col("n") % 10).count(), "counts").count() == 10
    table = KeyedTable(str(tmp_path / "t"), many.schema, prefixes=4).create(spark)
    table.upsert(many)
    table.upsert(many)
    for _ in range(50):  # they are removed in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left


def test_bloom_filters_are_as_large_as_their_keys_need(spark, tmp_path):
    """Each row group had one of a megabyte."""
    table = KeyedTable(str(tmp_path / "t"), keyed_rows(spark, 1).schema, prefixes=2).create(spark)
    table.upsert(keyed_rows(spark, 4000))
    assert max(f.stat().st_size for f in (tmp_path / "t" / "rows").rglob("*.parquet")) < 200_000


@pytest.mark.parametrize("query, own", [("k1_stream_ingest", {"ingested", "stream"}), ("k3_keyed_stream", {"keyed-packets", "stream"})])
def test_streams_read_the_stored_frames(spark, sf, query, own):
    """The frames were written a second time as records, and the packets were stored that only make the frames."""
    fx.frame_table(spark, sf)
    folder = staging.shared_folder(spark) + "/wireloom"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def names():
        path = fs.Path(folder)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        return {f.getPath().getName().rsplit("-", 1)[0]: f.getPath().getName() for f in found}

    before = names()
    assert QUERIES[query](spark, sf).count() == fx.frame_table(spark, sf).count()
    assert {n for n, path in names().items() if before.get(n) != path} <= own


def test_frames_are_the_same_with_and_without_a_packet_table(spark, sf, monkeypatch):
    monkeypatch.setattr(fx, "_TABLES", {})
    alone = fx.frame_table(spark, sf)
    assert [key[2] for key in fx._TABLES] == ["frames"]
    monkeypatch.setattr(fx, "_TABLES", {})
    fx.packet_table(spark, sf)
    of_packets = fx.frame_table(spark, sf)
    assert [key[2] for key in fx._TABLES] == ["packets", "frames"]
    assert alone.exceptAll(of_packets).isEmpty() and of_packets.exceptAll(alone).isEmpty()
