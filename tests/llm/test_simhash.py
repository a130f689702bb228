from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from wireloom.llm import golay, simhash

SF = "/root/testdata/sf0.01"


def slow_fingerprint(text: str | None) -> int:
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints: list[int], ids: list) -> list:
    p = np.array(prints, np.uint64)
    label = list(range(len(p)))
    todo = set(range(len(p)))
    while todo:
        start = todo.pop()
        queue = [start]
        while queue:
            i = queue.pop()
            near = [int(j) for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= 4) if int(j) in todo]
            for j in near:
                label[j] = start
            todo.difference_update(near)
            queue += near
    least = {}
    for lab, i in zip(label, ids, strict=True):
        least[lab] = i if least.get(lab) is None else least[lab] if i is None else min(i, least[lab])
    return [least[lab] for lab in label]


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    for bits in (0, 1, 2):
        other = words.copy()
        for row in range(len(words)):
            for b in rng.choice(23, bits, replace=False):
                other[row] ^= 1 << int(b)
        (a, use_a), (b, use_b) = golay.keys(words), golay.keys(other)
        for i in range(len(words)):
            assert set(a[i][use_a[i]]) & set(b[i][use_b[i]])
    assert set(use_a.sum(axis=1)) == {1, 6}


def test_every_error_pattern_shares_a_key():
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(4000)]
    other = []
    for x in base:
        for b in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << b
        other.append(x)
    keys = []
    for prints in (base, other):
        rows, found = simhash.fuzzy_keys(np.array(prints, np.uint64), products=True)
        mine = [set() for _ in prints]
        for r, k in zip(rows.tolist(), found.tolist(), strict=True):
            mine[r].add(k)
        keys.append(mine)
    assert all(a & b for a, b in zip(*keys, strict=True))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a BÉ c", "x " * 70_000, "a b c d e   f"])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_query_against_brute_force(spark):
    from wireloom.llm.queries import QUERIES

    got = QUERIES["op2_simhash_near_dedup"](spark, SF).toPandas().sort_values("doc_id")
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    prints = [slow_fingerprint(t) for t in rows.text]
    assert got.doc_id.tolist() == rows.doc_id.tolist()
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == slow_components(prints, rows.doc_id.tolist())


def test_chains_ties_and_nulls(spark, docs):
    """Random fingerprints in chains, given directly."""
    rng = random.Random(3)
    prints = []
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 30])):
            prints.append(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    unique = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    got = simhash.link_components(spark.createDataFrame([(p,) for p in unique], "_print bigint")).collect()
    want = slow_components([p % (1 << 64) for p in unique], unique)
    assert {r["_print"]: r["_part"] for r in got} == dict(zip(unique, want, strict=True))

    df = docs([(5, None), (3, ""), (None, "  "), (9, "word"), (9, "word"), (1, "other text here now"), (None, "word")])
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect()))
    assert [g[2] for g in got] == [1, 3, 3, 9, 9, 3, 9]
    left = simhash.representatives(df).collect()
    assert sorted(r.doc_id for r in left) == [1, 3, 9, 9]
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.representatives(docs([])).count() == 0
