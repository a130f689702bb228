from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wireloom.llm import decontaminate
from wireloom.llm.common import utf8
from wireloom.llm.wordhash import word_hashes, words


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def slow(text, items):
    own, hit, found = cut(text), set(), set()
    for item_id, item in items:
        w = cut(item)
        n = min(13, len(w))
        if not n:
            continue
        for j in range(len(w) - n + 1):
            for i in range(len(own) - n + 1):
                if own[i : i + n] == w[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
    return len(own), len(hit), sorted(found)


def run(spark, docs_rows, item_rows, docs):
    bench = spark.createDataFrame(item_rows, "item_id bigint, text string, _id string")
    rows = decontaminate.decontamination(docs(docs_rows).withColumnRenamed("source", "_items"), bench)
    return rows.select("_c0", "_c1", "_n_words", "_n_hit", F.array_sort("_items").alias("i"), decontaminate.contaminated().alias("c"))


def test_against_brute_force(spark, docs):
    rng = random.Random(5)
    vocabulary = ["a", "b", "É", "日本", "x1", "long-word", "C"]
    def say(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 5, 12, 13, 14, 30, 60])), "x") for i in range(25)]
    items += [(100, None, "x"), (101, " .,! ", "x"), (3, items[3][1], "x"), (None, say(15), "x")]
    texts = []
    for i in range(60):
        item = rng.choice(items)[1] or ""
        w = cut(item)
        part = " ".join(w[rng.randint(0, 3) : len(w) - rng.randint(0, 3)])
        texts.append((i, say(rng.randint(0, 60)) + " " + (part.upper() if i % 3 else part) + " " + say(rng.randint(0, 60))))
    texts += [(60, None), (61, ""), (62, "!!!"), (63, "a " * 3000), (5, texts[5][1]), (None, texts[6][1])]
    plain = [(i, t) for i, t, _ in items]
    for r in run(spark, texts, items, docs).collect():
        n, hit, found = slow(r._c1, plain)
        assert (r._n_words, r._n_hit) == (n, hit)
        assert [x for x in r.i if x is not None] == [f for f in found if f != "None"]
        assert r.c == (hit > 0 and 20 * hit >= n)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r._n_hit for r in decontaminate.decontamination(docs(["a b"]), none).collect()] == [0]
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontaminate.decontamination(docs([]), bench).count() == 0
    assert [r.doc_id for r in decontaminate.clean(docs(["a b", "c d"]), bench).collect()] == [1]


@pytest.mark.parametrize("span", [1, 2, 3, 7, 13, 20])
def test_every_shared_span_keeps_a_fingerprint(span):
    rng = np.random.default_rng(span)
    hashes = rng.integers(0, 30, 3000).astype(np.uint64)
    bounds = np.array([0, 5, 5, 700, 3000])
    owner, prints = decontaminate._grams(hashes, bounds, span, winnow=True)
    mine = {(o, p) for o, p in zip(owner.tolist(), prints.tolist(), strict=True)}
    for t in range(4):
        for i in range(bounds[t], bounds[t + 1] - span + 1):
            _, own = decontaminate._grams(hashes[i : i + span], np.array([0, span]), span, winnow=False)
            assert any((t, p) in mine for p in own.tolist())


def test_words_of_many_texts_at_once():
    import pyarrow as pa

    texts = ["Ab c", "", None, "d", "É--é1", "z" * 50_000, "ab C"]
    data, offsets = utf8(pa.array(["skip", *texts]).slice(1))
    starts, ends, bounds = words(data, offsets)
    whole = data.tobytes()
    got = [[whole[starts[i] : ends[i]].decode() for i in range(bounds[t], bounds[t + 1])] for t in range(len(texts))]
    assert [[w.lower() if w.isascii() else w for w in g] for g in got] == [cut(t) for t in texts]
    h = word_hashes(data, starts, ends)
    assert h[0] == h[-2] and h[1] == h[-1] and len(set(h.tolist())) == len(h) - 2
