from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan_text
from wireloom.llm import merkle
from wireloom.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def slow_tree(digests):
    """Root of a list of nodes, and of each the list of (left, right) from below."""
    paths, owners = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [range(i, min(i + 3, len(digests))) for i in range(0, len(digests), 3)]
        for run in runs:
            for i in run:
                at = "".join(digests[j] for j in run if j < i), "".join(digests[j] for j in run if j > i)
                for o in owners[i]:
                    paths[o].append(at)
        digests = [h(*(digests[i] for i in run)) for run in runs]
        owners = [sum((owners[i] for i in run), []) for run in runs]
    return (digests[0] if digests else None), paths


def slow_manifest(rows):
    """Rows (doc_id, text, lang, source, n_chars) to the columns of the query."""
    groups = {}
    for id, text, lang, source, n in rows:
        cut = text.replace("\n", "") if text is not None and id is not None and zlib.crc32(str(id).encode()) % 2 == 0 else text
        one = id, slow_leaf(id, source, lang, n, text), slow_leaf(id, source, lang, n, cut)
        groups.setdefault(source, []).append(one)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: slow_tree([r[1] for r in groups[s]]) for s in names}
    root, above = slow_tree([trees[s][0] for s in names])
    out = []
    for s, upper in zip(names, above, strict=True):
        for (id, leaf, changed), path in zip(groups[s], trees[s][1], strict=True):
            whole, folded = path + upper, changed
            for left, right in whole:
                folded = h(left, folded, right)
            proof = h(*(x + y for x, y in whole))
            out.append((id, leaf, trees[s][0], root, proof, folded, folded == root))
    return out


def ran(spark, tmp_path, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    for name, c in more.items():
        df = df.withColumn(name, c)
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_against_brute_force(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = [(i, f"line\n{i}\nend" if i % 3 else f"one line {i}", "en", f"s{i % 5}" if i % 2 else "hot", i) for i in range(97)]
    rows += [(i, "only", None, s, None) for i, s in ((200, None), (201, ""), (202, "é"), (203, "z"), (204, "Z"))]
    rows += [(300 + i, None if i % 2 else "", "de", None, 0) for i in range(4)]
    rows += [(7, "line\n7\nend", "en", "s2", 7)] * 3 + [(7, "other", "en", "s2", 7), (None, "a\nb", "en", "s2", 3), (None, None, None, None, None)]
    rows.append((500, "x\n" * 200_000, "fr", "s1", -5))
    got = ran(spark, tmp_path, rows, leaf=F.lit(1), _g=F.lit("clash"), path=F.lit(0.5), root=F.col("text"))
    assert sorted(got, key=repr) == sorted(slow_manifest(rows), key=repr)
    assert len({r[3] for r in got}) == 1


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_every_size_of_a_single_source(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(i, f"a\n{i}", "en", "s", i) for i in range(n)]
    assert sorted(ran(spark, tmp_path, rows)) == sorted(slow_manifest(rows))


def test_an_empty_table_has_no_rows(spark, tmp_path):
    assert ran(spark, tmp_path, []) == []


def test_other_columns_of_another_name(spark):
    df = spark.createDataFrame([(1, "g", "x"), (2, "g", "y"), (3, None, None)], "key int, part string, body string")
    got = {r.key: r for r in merkle.manifest(df, "key", "part", ["key", "body"]).collect()}
    lone, first, second = (slow_leaf(*v) for v in ((3, None), (1, "x"), (2, "y")))
    assert got[3].leaf == got[3].subroot == lone
    assert got[1].subroot == h(first, second) and got[1].root == h(lone, h(first, second))
    assert [tuple(p) for p in got[2].path] == [(first, ""), (lone, "")]


def test_a_changed_leaf_does_not_fold_to_the_root(spark, docs):
    rows = merkle.manifest(docs(["a", "b", "c", "d"]), also={"wrong": F.sha2(F.lit("wrong"), 256)})
    for r in rows.select("root", merkle.fold(F.col("leaf"), F.col("path")).alias("right"), merkle.fold(F.col("wrong"), F.col("path")).alias("wrong")).collect():
        assert r.right == r.root != r.wrong


def test_no_window_is_larger_than_a_block(spark, docs):
    nodes = spark.range(10).selectExpr("unhex(hex(id % 2)) _g", "id _pos", "5L _n", "hex(id) _d")
    plan = plan_text(merkle._climbed(nodes, 2))
    assert "hashpartitioning(_g" in plan and plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
    assert "Python" not in plan and "Arrow" not in plan
