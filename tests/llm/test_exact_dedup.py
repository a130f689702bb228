from __future__ import annotations

import hashlib
import random

import pytest

from wireloom.llm import exact_dedup


def slow(rows):
    by_text: dict = {}
    for doc_id, text in rows:
        by_text.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in by_text.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_groups_of_every_size_cross_partitions(spark, docs, partitions):
    rng = random.Random(partitions)
    rows = [(i, rng.choice(["hot"] * 6 + ["hot but longer than sixteen bytes"] * 3 + [None, "", f"own {i}", "x" * 300_000])) for i in range(400)]
    rows += [(7, "hot"), (7, "hot"), (None, "hot"), (None, "only null id"), (None, "only null id")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = docs(rows).withColumnRenamed("source", "keep_id").withColumnRenamed("lang", "_text")
        got = exact_dedup.duplicates(df).collect()
        left = exact_dedup.survivors(df)
        kept = left.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == slow(rows)
    stays = [r for r in got if r.kept]
    assert len(stays) == len({t or "" for _, t in rows}) == len(kept)
    assert all(r.doc_id == r.keep_id for r in stays)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == sorted((max([i for i, t in rows if (t or "") == text and i is not None], default=-1), text) for text in {t or "" for _, t in rows})


def test_empty_table(spark, docs):
    assert exact_dedup.duplicates(docs([])).count() == 0
    assert exact_dedup.survivors(docs([])).count() == 0
