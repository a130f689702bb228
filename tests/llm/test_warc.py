from __future__ import annotations

import base64
import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wireloom.llm import warc
from wireloom.llm.common import new_path

DAY = datetime.datetime(2024, 1, 2, tzinfo=datetime.timezone.utc)
CAPTURES = "id bigint, url string, payload string, time timestamp"


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 33])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randint(0, 20) for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(k)]
    got = [(runs[r][i], r, i) for r, i in warc.LoserTree(runs)]
    assert got == sorted((x, r, i) for r, run in enumerate(runs) for i, x in enumerate(run))


def slow(rows):
    out = []
    for id_, _, payload, _ in rows:
        p = (payload or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (payload or "") and r[0] is not None]
        top = max(same, default=None)
        revisit = top is not None and id_ != top
        out.append((id_, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a.example/x", "<p>same</p>", DAY), (2, "http://b.example/", "<p>same</p>", DAY),
    (3, "http://a.example/x", "", DAY), (4, None, None, DAY), (5, "http://é.example/a b\r\nX: y", "WARC/1.1\r\n\r\n\r\n\r\nbody\n", DAY),
    (None, "http://a.example/n", "only null", DAY), (None, "http://a.example/n", "<p>same</p>", DAY), (7, "no scheme", "é" * 100_000, DAY),
    (8, "http://[bad", "x", DAY), (2, "http://b.example/", "<p>same</p>", DAY),
]


def test_round_trip_and_global_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 2)
    rows = ROWS + [(100 + i, f"http://h{i % 7}.example/{i % 3}", f"page {i % 40}", DAY - datetime.timedelta(seconds=i % 5)) for i in range(300)]
    df = spark.createDataFrame(rows, CAPTURES).repartition(5)
    index = warc.archived(df.withColumn("urlkey", F.lit(1)).withColumn("digest", F.lit(2))).cache()
    got = index.collect()
    assert sorted([(r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == slow(rows)
    keys = [(r.urlkey, r.timestamp, r.id is not None, r.id or 0) for r in got]
    assert keys == sorted(keys)
    assert len({r.run for r in got}) > 50


def test_index_places_give_the_records(spark):
    df = spark.createDataFrame(ROWS, CAPTURES)
    path = new_path(spark, "warc-test")
    warc.write_archives(df, path)
    files = {r.path.rpartition("/")[2]: bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()}
    for r in warc.read_index(spark, path).collect():
        record = files[r.run][r.offset : r.offset + r.length]
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: ") and record.endswith(b"\r\n\r\n")
        assert [x[2:] for x in warc.parse(record)] == [(r.id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.url, 0, r.length)]


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame(ROWS, CAPTURES)
    kinds = {r.size: r.record_type for r in warc.with_types(df, minimum=5).where("size < 5").collect()}
    assert set(kinds.values()) == {"response"}


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], CAPTURES)).count() == 0


def test_damage_is_reported():
    with pytest.raises(ValueError):
        list(warc.parse(b"HTTP/1.1 200 OK\r\n\r\n"))
