from __future__ import annotations

import math
from collections import Counter

import pytest

from wireloom.llm import quality


def folded(c: str) -> str:
    low = "0" if c.isdigit() else " " if ord(c) < 32 and c != "\n" else c.lower()
    return low if len(low) == 1 else c


def ranked(texts: list[str]) -> list[str]:
    """Characters with symbols of their own, from the definition."""
    n = Counter(folded(c) for t in texts for c in t)
    return sorted(n, key=lambda c: (-n[c], c))[: 4096 - 258]


def slow_grams(text: str, own: list[str]) -> list[tuple[int, ...]]:
    def symbol(c: str) -> int:
        c = folded(c)
        return 258 + own.index(c) if c in own else 2 + ord(c) // 256 % 256

    s = [0] * 4 + [symbol(c) for c in text] + [1]
    return [tuple(s[i : i + 5]) for i in range(len(s) - 4)]


class SlowModel:
    """The model as its definition, from dictionaries."""

    def __init__(self, texts: list[str], own: list[str] | None = None):
        self.own = ranked(texts) if own is None else own
        self.c = {5: Counter(g for t in texts for g in slow_grams(t, self.own))}
        for n in (4, 3, 2, 1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        self.d = {n: quality.discounts(Counter(c for c in self.c[n].values() if c <= 4)) for n in self.c}

    def p(self, gram: tuple[int, ...]) -> float:
        n = len(gram)
        if n == 0:
            return 1 / 4096
        lower = self.p(gram[1:])
        after = [c for g, c in self.c[n].items() if g[:-1] == gram[:-1]]
        if not after:
            return lower
        c, d = self.c[n][gram], self.d[n]
        own = c - d[min(c, 3) - 1] if c else 0.0
        left = sum(d[min(x, 3) - 1] for x in after)
        return (own + left * lower) / sum(after)

    def bits(self, text: str) -> float:
        grams = slow_grams(text, self.own)
        return -sum(math.log2(self.p(g)) for g in grams) / len(grams)


TRUSTED = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "Ünder 42 čats", ""]
OTHERS = ["the cat", "zzz qqq", "", None, "DOGS 17\t!", "日本語 text \ufffe\uffff 仾仿", "x" * 3000]


@pytest.mark.parametrize("common", [1, 40, 10**6])
def test_probabilities_against_the_definition(spark, docs, monkeypatch, common):
    monkeypatch.setattr(quality, "COMMON", common)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 40)
    monkeypatch.setattr(quality, "PACK_BYTES", 16)
    df = docs([*TRUSTED, *OTHERS])
    model = quality.CountTables(docs(TRUSTED))
    slow = SlowModel(TRUSTED)
    got = {r._id: r for r in quality.perplexities(df, model, "doc_id", "lang", "text").collect()}
    for i, text in enumerate([*TRUSTED, *OTHERS]):
        assert got[i]._n == len(text or "") + 1
        assert got[i]._bits == pytest.approx(slow.bits(text or ""), rel=1e-6)


def test_a_context_sums_to_one():
    slow = SlowModel(TRUSTED)
    context = slow_grams("the c", slow.own)[-2][:-1]
    seen = {g[-1] for g in slow.c[1]}
    total = sum(slow.p((*context, s)) for s in seen)
    unseen = slow.p((*context, 4000))
    assert total + (4096 - len(seen)) * unseen == pytest.approx(1)


def test_grams_of_many_texts_equal_those_of_each():
    texts = ["ab", "", "c", "a longer one", "é日"]
    own = ["a", "b", "日"]
    grams, first = quality.grams_of(texts, tuple(map(ord, own)))
    ends = [*first[1:].tolist(), len(grams)]
    for t, a, b in zip(texts, first.tolist(), ends, strict=True):
        want = [sum(s << 12 * (4 - i) for i, s in enumerate(g)) for g in slow_grams(t, own)]
        assert grams[a:b].tolist() == want


def test_query_keeps_clean_text_and_rejects_junk(spark, sf):
    from wireloom.llm.queries import QUERIES

    got = QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == got.doc_id.nunique() == 1000
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    m = got.merge(labels, on="doc_id")
    assert m[(m.quality == 1) & (m.toxic == 0)].kept.mean() > 0.97
    assert m[m.quality == 0].kept.mean() < 0.3


def test_odd_tables(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    df = docs([(0, "good words"), (0, "good words"), (1, "good word"), (2, "####"), (None, None), (3, "good", None)])
    df = df.withColumn("_bits", df.doc_id).withColumn("kept", df.doc_id)
    got = quality.classify(df, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 0), (False, 0), (False, 1), (False, 2), (False, 3), (True, 0)]
    assert all(r.kept for r in got if r.doc_id in (0, 1))
    assert not any(r.kept for r in got if r.doc_id == 2)
    assert quality.classify(docs([]), labels).count() == 0
    none = quality.classify(docs(["a", "b"]), labels.limit(0)).collect()
    assert [r.kept for r in none] == [True, True] and {round(r.perplexity) for r in none} == {4096}


def test_held_out_scores_leave_out_the_fold_of_the_text(spark, docs):
    model = quality.CountTables(docs(TRUSTED))
    folds = quality.folds_of(TRUSTED).tolist()
    assert len(set(folds)) > 1
    rows = [*TRUSTED, *(t or "" for t in OTHERS)]
    got = {r._id: r for r in quality.perplexities(docs(rows), model, "doc_id", "lang", "text").collect()}
    for i, (text, fold) in enumerate(zip(rows, quality.folds_of(rows).tolist(), strict=True)):
        slow = SlowModel([t for t, f in zip(TRUSTED, folds, strict=True) if f != fold], ranked(TRUSTED))
        assert got[i]._held == pytest.approx(slow.bits(text), rel=1e-5)


def test_clean_documents_with_hidden_labels_stay(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    hidden = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels.where(~hidden)).toPandas()
    m = got.merge(labels.where(hidden).toPandas(), on="doc_id")
    kept = m[(m.quality == 1) & (m.toxic == 0)].groupby("lang").kept.mean().to_dict()
    assert set(kept) == {"de", "en", "es", "fr"} and min(kept.values()) > 0.8, kept
    assert m[m.quality == 0].kept.mean() < 0.3


def test_every_script_keeps_its_characters(spark, docs):
    """20,000 Han characters: the commonest have symbols of their own, the rest those of their blocks."""
    han = [chr(0x4E00 + i) for i in range(20_000)]
    texts = ["".join(han), "".join(han[:3000] * 2), "한국어 텍스트 \ufffe"]
    own = quality.alphabet(docs(texts))
    assert [chr(c) for c in own] == ranked(texts) and len(own) == 4096 - 258
    table = quality.symbol_table(own)
    assert len({int(table[ord(c)]) for c in han[:3000]}) == 3000
    rare = {int(table[ord(c)]) for c in han} - set(range(258, 4096))
    assert 50 < len(rare) <= 256 and not rare & {quality.START, quality.END}
    assert int(table[0xFFFE]) not in (quality.START, quality.END) and int(table[0x4EFE]) != quality.START


def slow_quantile(values: list[float], q: float, above: bool) -> float:
    """The limit in hundredths of a bit: of the smallest step that holds the share."""
    steps = sorted(math.floor(v * quality.STEPS) for v in values)
    if above:
        return next(s + 1 for i, s in enumerate(steps, 1) if i >= q * len(steps) and (i == len(steps) or steps[i] != s)) / quality.STEPS
    return next(s for i, s in enumerate(steps, 1) if sum(x <= s for x in steps) > q * len(steps)) / quality.STEPS


def test_limits_and_kept_against_brute_force(spark, docs):
    import random

    rng = random.Random(4)
    langs = {"en": 60, "de": 9, "fr": 1, None: 3}
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows, i = [], 0
    for lang, n in langs.items():
        for _ in range(n):
            rows.append((i, " ".join(rng.choices(words, k=rng.randrange(3, 30))), lang))
            i += 1
    trusted = [r for r in rows if rng.random() < 0.6 and r[2] != "fr"]
    rows += [(1000 + j, "#" * 40, lang) for j, lang in enumerate(langs)] + [(2000, "alpha " * 50, "xx")]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in trusted], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs(rows), labels).collect()}
    texts = [r[1] for r in trusted]
    folds, own = quality.folds_of(texts).tolist(), ranked(texts)
    whole = SlowModel(texts, own)
    without = {f: SlowModel([t for t, g in zip(texts, folds, strict=True) if g != f], own) for f in range(quality.FOLDS)}
    held = {r[0]: without[int(quality.folds_of([r[1]])[0])].bits(r[1]) for r in rows}
    in_all = {r[0]: whole.bits(r[1]) for r in trusted}
    for doc_id, text, lang in rows:
        mine = [r[0] for r in trusted if r[2] == lang] or [r[0] for r in trusted]
        high = slow_quantile([held[x] for x in mine], quality.QUANTILE, True)
        low = min(slow_quantile([s[x] for x in mine], quality.LOW_QUANTILE, False) for s in (held, in_all))
        slack = quality.MARGIN + quality.WIDTH / math.sqrt(len(text) + 1)
        r = got[doc_id]
        assert math.log2(r.perplexity) == pytest.approx(held[doc_id], rel=1e-5)
        assert math.log2(r.low) == pytest.approx(low - slack, abs=0.0101) and math.log2(r.high) == pytest.approx(high + slack, abs=0.0101)
        if min(abs(held[doc_id] - low + slack), abs(held[doc_id] - high - slack)) > 0.011:
            assert r.kept == (low - slack <= held[doc_id] <= high + slack), doc_id
