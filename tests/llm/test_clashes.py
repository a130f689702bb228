"""Callers' columns that have the names the operators use inside, and ids that repeat."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from wireloom.llm import bpe, decontaminate, license_scan, simhash, url_filter, warc

SF = "/root/testdata/sf0.001"


def test_representatives(spark, docs):
    df = docs([(1, "a b c d e"), (2, "a b c d e"), (3, "other words of a text")]).withColumn("_gone", F.lit("x")).withColumn("_gone_", F.lit(1))
    got = simhash.representatives(df)
    assert got.columns == df.columns and sorted((r.doc_id, r._gone, r._gone_) for r in got.collect()) == [(1, "x", 1), (3, "x", 1)]


def test_language_stage(spark, docs):
    real = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_found", F.lit("mine"))
    got = corpus_pipeline.language(spark, real, SF)
    assert got.columns == real.columns and {r._found for r in got.select("_found").distinct().collect()} == {"mine"}


def test_encoded(spark, docs):
    tokens = public_tokenizers.path("byte_bpe_50k.json")
    df = docs(["some text", None]).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit("y"))
    got = bpe.encoded(df, tokens, bpe.build_lexicon(df, tokens), check=True)
    assert sorted(r.decoded for r in got.select("ids", "decoded").collect()) == ["", "some text"]


def test_license_ids_of_any_name(spark, docs):
    for name in ("key", "places", "found", "_text", "hits"):
        df = docs([(7, "mit license")]).withColumnRenamed("doc_id", name)
        row = license_scan.scan(df, id=name).first()
        assert (row[0], row[1], row[2][0].start) == (7, 2, 0)


def test_judged(spark):
    df = spark.createDataFrame([("http://a.org/x", "mine")], "url string, judged string")
    assert url_filter.judge_urls(df).first().judged.verdict == "allow"
    kept = url_filter.judge_urls(df.withColumn("_judged", F.lit(1)), out="told").first()
    assert (kept.judged, kept._judged, kept.told.host) == ("mine", 1, "a.org")


def test_items_that_share_an_id(spark, docs):
    bench = spark.createDataFrame([(7, "a b c"), (7, "d e f"), (7, "d e f"), (8, "a b c"), (None, "c x")], "item_id bigint, text string")
    rows = decontaminate.decontamination(docs(["a b c x d e f"]), bench).select("_n_hit", F.array_sort("_items").alias("i")).first()
    assert rows._n_hit == 7 and rows.i == ["7", "8", None]


def test_archives_of_long_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 50)
    sizes = [10] * 120 + [3_000] * 40 + [30_000] * 9 + [400_000] * 2 + [0]
    rows = [(i, f"http://h{i % 7}.org/{i}", chr(97 + i % 26) + "x" * (n - 1) if n else None) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "id bigint, url string, payload string").withColumn("time", F.timestamp_seconds(F.lit(1)))
    path = str(tmp_path / "archives")
    warc.write_archives(df.withColumn("class", F.lit(0)).repartition(2), path)
    files = [f.stat().st_size for f in (tmp_path / "archives").glob("*.txt")]
    assert sum(f > 200_000 for f in files) == 2 and len(files) > 8
    index = warc.read_index(spark, path).collect()
    assert {(r.id, r.payload_bytes) for r in index} == set(enumerate(sizes))
