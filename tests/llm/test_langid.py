from __future__ import annotations

import itertools

import numpy as np
import pytest

from wireloom.llm import langid

EN = "the cat and the dog were in the house with all of their things and that was good"
FR = "le chat et le chien étaient dans la maison avec toutes leurs choses et tout était bien"
RU = "кошка и собака были в доме со всеми вещами и это было хорошо"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 1, 1, 6, 11, 17])
    scores = -rng.exponential(3, (17, 3))
    got = langid.viterbi(scores, bounds, 2.0)
    def value(s, path):
        return sum(s[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
    for a, b in zip(bounds, bounds[1:], strict=False):
        best = max((value(scores[a:b], p) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert value(scores[a:b], got[a:b]) == pytest.approx(best)


def test_spans_of_mixed_text_and_odd_rows(spark, docs):
    train = docs([(i, t, n) for i, (t, n) in enumerate([(EN, "en"), (FR, "fr"), (RU, "ru"), (EN, "en"), (None, "en"), ("", "fr"), ("123", "zz"), (EN, None)])])
    model = langid.fit(train)
    assert model.languages == ["en", "fr", "ru"]
    mixed = EN + ". " + FR + "! " + RU
    rows = [mixed, EN, "", None, "123 !?", "αβγ δε", "x" * 200_000, "the İstanbul cat and the dog"]
    df = docs(rows).withColumnRenamed("source", "spans").withColumnRenamed("n_chars", "score")
    got = {r.doc_id: r.f for r in df.select("doc_id", langid.labelled(df, model).alias("f")).collect()}
    spans = [(mixed[s.start : s.end], s.lang) for s in got[0].spans]
    assert spans == [(EN, "en"), (FR, "fr"), (RU, "ru")]
    assert got[0].lang == "fr" and 0.3 < got[0].score < 0.5
    assert (got[1].lang, got[1].score) == ("en", 1.0)
    for i in (2, 3, 4):
        assert (got[i].lang, got[i].score, got[i].spans) == ("und", 0.0, [])
    assert got[5].lang in model.languages and got[7].lang == "en"
    assert langid.label(["abc"], langid.fit(docs([]))) == [("und", 0.0, [])]
    assert docs([]).select(langid.labelled(docs([]), model)).count() == 0


def test_texts_do_not_touch_each_other(docs, spark):
    model = langid.fit(docs([(0, EN, "en"), (1, FR, "fr")]))
    rows = [EN, "", FR, "le", "the", "!"]
    assert langid.label(rows, model) == [langid.label([t], model)[0] for t in rows]


def test_held_out_accuracy(spark):
    import zlib

    from wireloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op9_language_id"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    m = got.merge(docs, on="doc_id")
    assert len(m) == len(docs)
    assert m.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in m.doc_id]
    assert (m[m.held_out].lang == m[m.held_out].lang_pred).mean() > 0.99


def test_more_than_64_languages_are_learned(spark, docs):
    # Each language has words of its own; the rarest come last.
    words = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(70)]
    texts = [" ".join(f"{w}{c}{w}" for c in "aeiou") for w in words]
    rows = [(i, " ".join([t] * (2 if i < 64 else 1)), f"l{i:02}") for i, t in enumerate(texts)]
    model = langid.fit(docs(rows))
    assert model.languages == [f"l{i:02}" for i in range(70)]
    assert [langid.label([t], model)[0][0] for t in texts] == model.languages
