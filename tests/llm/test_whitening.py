from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wireloom.llm import spectrum, whitening
from wireloom.llm.queries import QUERIES


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


SPECTRA = {
    "apart": np.arange(20, 0, -1.0) ** 2,
    "geometric": 0.5 ** np.arange(24),
    "equal": np.array([9.0] * 4 + [4.0] * 3 + [1.0] * 5),
    "close": np.array([5.0, 5.0 - 1e-12, 5.0 - 1e-9, 3.0, 3.0 - 1e-6, 1.0, 0.5]),
    "without full rank": np.array([4.0, 2.0, 1.0, 0, 0, 0, 0]),
    "both signs": np.array([3.0, 1.0, 0.0, -2.0, -7.0]),
    "one": np.array([2.0]),
}


@pytest.mark.parametrize("name", SPECTRA)
@pytest.mark.parametrize("seed", range(4))
def test_eigenpairs(name, seed):
    a = symmetric(SPECTRA[name], seed)
    want = np.sort(SPECTRA[name])[::-1]
    for k in {1, min(3, len(a)), len(a)}:
        values, vectors = spectrum.leading(a, k)
        assert np.allclose(values, want[:k], atol=1e-13 * np.abs(want).max() * len(a))
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-7
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * np.abs(want).max() * len(a)


@given(st.lists(st.integers(-4, 4), min_size=36, max_size=36), st.integers(-9, 9))
@settings(max_examples=200, deadline=None)
def test_counts_of_whole_matrices(entries, shift):
    """Matrices of small whole numbers have many zero and equal pivots."""
    a = np.array(entries, float).reshape(6, 6)
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    if np.abs(values - (shift + 0.25)).min() > 1e-9:
        assert spectrum.above(a, shift + 0.25) == (values > shift + 0.25).sum()
    found, vectors = spectrum.leading(a, 6)
    assert np.allclose(found, values[::-1], atol=1e-11)
    assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-7


def test_matrices_that_need_pairs_as_pivots():
    a = np.array([[0.0, 1], [1, 0]])
    assert [spectrum.above(a, s) for s in (-2.0, 0.0, 2.0)] == [2, 1, 0]
    assert spectrum.above(np.zeros((3, 3)), 0.0) == 0
    assert spectrum.leading(np.zeros((3, 3)), 2)[0].tolist() == [0, 0]


def test_a_wrong_number_is_not_certified():
    a = symmetric([4.0, 3.0, 1.0])
    with pytest.raises(ArithmeticError):
        spectrum.certified(a, np.array([4.0, 1.0]), 4.0)


def brute(rows, components=32):
    """Rows (id, vector) of one length to the exact sums and, by numpy's solver, everything else."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    deviation = [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]
    z = np.array([[float(Fraction(n * r[i] - s[i], n)) for i in range(d)] for r in x])
    v = z.T @ z / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return [i for i, _ in kept], deviation, z @ vectors / np.sqrt(np.maximum(values, 1e-300)), values / np.trace(v)


def ran(spark, tmp_path, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).collect()


def same(got, rows):
    ids, deviation, w, explained = brute(rows)
    k = w.shape[1]
    assert len(got) == len(ids) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for at, i in enumerate(ids):
        for c in range(k):
            r = by[i, c + 1].pop()
            sign = signs.setdefault(c, 1 if abs(r.whitened - w[at, c]) < abs(r.whitened + w[at, c]) else -1)
            assert r.n == len(ids) and r.deviation == deviation[at]
            assert r.whitened == pytest.approx(sign * w[at, c], abs=1e-6)
            assert r.explained == pytest.approx(explained[c], rel=1e-9)
            assert r.identity_error < 1e-9


def test_query_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    same(QUERIES["op12_embedding_whitening"](spark, sf).collect(), rows)


VEC = "vec_id bigint, embedding array<float>, label int"


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * [3, 2, 1, 0.5, 0.25]]) for i in range(60)]
    more = [*rows, rows[0], (1, rows[7][1])]  # a repeated row, a repeated id
    dropped = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [math.nan] * 5), (103, [0.0] * 4 + [math.inf]), (104, []), (105, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in more + dropped], VEC)
    got = ran(spark, tmp_path, df.withColumn("component", F.lit("x")).withColumn("n", F.lit(0)).withColumn("id", F.lit(0)))
    assert all(r.vec_id < 100 for r in got)
    assert {r.n for r in got} == {len(more)} and len(got) == 5 * len(more)
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(brute(more)[1])


def test_tables_without_variance(spark, tmp_path):
    def table(rows):
        return spark.createDataFrame(rows, VEC)

    for rows in ([], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(5)], [(1, None, 0), (2, [], 0)]):
        assert ran(spark, tmp_path, table(rows)) == []
    line = ran(spark, tmp_path, table([(i, [float(i), 2.0 * i, 7.0], 0) for i in range(9)]))
    assert {r.component for r in line} == {1} and line[0].explained == pytest.approx(1)
    assert sum(r.whitened**2 for r in line) / 9 == pytest.approx(1)


def test_large_entries_are_summed_exactly(spark, tmp_path):
    rows = [(i, [float(2**35 * (i % 5)), float(i), float(-(2**28) * i * i)]) for i in range(40)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, label int")
    got = ran(spark, tmp_path, df)
    want = brute(rows)[1]
    assert {(r.vec_id, r.deviation) for r in got} == {(i, d if d < 2**63 else None) for (i, _), d in zip(rows, want, strict=True)}
    huge = spark.createDataFrame([(1, [1e30, 0.0], 0), (2, [1.0, 2.0], 0), (3, [2.0, 2.0], 0)], "vec_id bigint, embedding array<double>, label int")
    assert {r.vec_id for r in ran(spark, tmp_path, huge)} == {2, 3}


def test_sums_do_not_depend_on_partitions(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    one, many = whitening.fit(table.coalesce(1)), whitening.fit(table.repartition(13))
    assert one.n == many.n and (one.vectors == many.vectors).all() and (one.values == many.values).all()
