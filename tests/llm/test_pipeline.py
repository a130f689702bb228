from __future__ import annotations

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from .test_decontaminate import slow as contamination
from .test_near_copies import slow_groups

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    last = {t or "": i for i, t in sorted(docs.items())}
    docs = {i: t for i, t in docs.items() if last[t or ""] == i and any(c.isalpha() for c in t or "")}
    docs = {i: docs[i] for i, first in slow_groups(sorted(docs.items())) if i == first}
    judged = {i: contamination(t, bench) for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if not (judged[i][1] > 0 and 20 * judged[i][1] >= judged[i][0])}
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in docs.items():
        ids = theirs.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)


def test_stages_take_odd_and_empty_tables(spark, docs):
    rows = [(1, "the same words here"), (2, "the same words here"), (3, None), (4, ""), (5, "12 34"), (6, "the other words are these and more")]
    df = docs(rows).withColumnRenamed("n_chars", "_text")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, df, SF)
        assert out.columns == df.columns, name
        left = sorted(r.doc_id for r in out.collect())
        assert left == {"language": [1, 2, 6], "exact_copies": [2, 4, 5, 6]}.get(name, left)
        assert step(spark, docs([]), SF).count() == 0
    assert {r.doc_id for r in corpus_pipeline.tokens(spark, df, SF).collect()} == {1, 2, 3, 4, 5, 6}


def test_language_stage_rejects_unlearned_scripts_and_gibberish(spark):
    from pyspark.sql import functions as F

    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.lang: r.text for r in real.where("length(text) > 1000").groupBy("lang").agg(F.max_by("text", "doc_id").alias("text")).collect()}
    bad = ["το γρήγορο άλογο πηδά πάνω από το σκυλί", "日本語の文章です。", "xqzvkjw qjxzvwk zzxqkvj wvqxjkz kqxvzzj jxqwvkz", None]
    good = [texts["en"], texts["en"][:900] + "\n" + texts["de"][:900], "The people of the city were there and it was good."]
    # Null ids are not learned from; these are told by their source.
    rows = [(None, t, "en", k, 0) for k, some in (("bad", bad), ("good", good)) for t in some]
    out = corpus_pipeline.language(spark, real.unionByName(spark.createDataFrame(rows, real.schema)), SF)
    got = {r[0]: r[1] for r in out.groupBy("source").count().collect()}
    assert "bad" not in got and got["good"] == len(good)
    assert sum(n for k, n in got.items() if k != "good") == real.count()
