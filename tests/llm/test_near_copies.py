from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from wireloom.llm import near_copies
from wireloom.llm.wordhash import gram_hashes, mixed, powers


def slow_hashes(text):
    """Word hashes one by one."""
    out = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        values = near_copies._BYTES[np.frombuffer(w, np.uint8)]
        out.append(int(mixed(np.array([(values * powers(np.uint64(0x9E3779B97F4A7C15), len(w))).sum(dtype=np.uint64)]))[0]))
    return np.array(out, np.uint64)


def slow_print(text):
    """Majority of the bits of all different shingles, bit by bit."""
    h = slow_hashes(text)
    if not len(h):
        return (0,) * near_copies.LONGS
    grams = {int(g) for g in gram_hashes(h, min(5, len(h)))}
    out = []
    for salt in near_copies._SALTS:
        bits = [int(mixed(np.array([g], np.uint64) ^ salt)[0]) for g in grams]
        # The numbers are stored byte by byte with the first bit on top.
        raw = [sum(2 * sum((b >> (8 * byte + bit)) & 1 for b in bits) > len(bits) and 1 << bit for bit in range(8)) for byte in range(8)]
        out.append(int.from_bytes(bytes(raw), "little"))
    return tuple(out)


def slow_groups(rows):
    """Of rows (id, text) the smallest id of each group, from all pairs of fingerprints."""
    prints = [slow_print(t) for _, t in rows]
    nodes = sorted(set(prints))
    low, high = (np.array([p[i] for p in nodes], np.uint64) for i in (0, 1))
    keys = [set() for _ in nodes]
    found = near_copies.keys(low, high, near_copies.PAIRS)
    for n, k in zip(*(x.tolist() for x in found), strict=True):
        keys[n].add(k)
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(nodes):
        for j in range(i):
            b = nodes[j]
            near = (a[0] ^ b[0]).bit_count() + ((a[1] ^ b[1]) & (1 << 51) - 1).bit_count()
            every = sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
            if keys[i] & keys[j] and near <= near_copies.MOST_BITS and every <= int(near_copies.MOST_SHARE * 512):
                parent[root(i)] = root(j)
    at = {p: root(i) for i, p in enumerate(nodes)}
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None and (least.get(at[p]) is None or i < least[at[p]]):
            least[at[p]] = i
    return [(i, least.get(at[p])) for (i, _), p in zip(rows, prints, strict=True)]


def say(rng, n):
    return [rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") + rng.choice("lmnrst") + str(rng.randrange(40)) for _ in range(n)]


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = "new" + str(rng.randrange(10**6))
    return out


def test_fingerprints_and_groups_against_brute_force(spark, docs):
    rng = random.Random(1)
    rows = []
    for i in range(25):
        base = say(rng, rng.choice([1, 3, 5, 40, 120]))
        rows += [(10 * i + j, " ".join(edited(rng, base, j if len(base) > 30 else 0)) + " " * j) for j in range(4)]
    hub = say(rng, 150)
    rows += [(1000 + j, " ".join(edited(rng, hub, 1 + j % 3)).upper()) for j in range(60)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (5, rows[5][1]), (None, rows[6][1]), (None, "alone here"), (2003, "é ü 日本 \x85 x")]
    df = docs(rows).withColumn("_p0", F.lit(1)).withColumn("component", F.lit("x")).withColumn("_id", F.lit(2))
    got = [tuple(r) for r in near_copies.near_groups(df).collect()]
    assert sorted(got, key=repr) == sorted(slow_groups(rows), key=repr)
    cut = [tuple(r) for r in near_copies.near_groups(df, bucket_rows=6).collect()]
    assert sorted(cut, key=repr) == sorted(got, key=repr)
    found = near_copies.fingerprints(df, "doc_id", "text").collect()
    assert sorted((tuple(x % (1 << 64) for x in r[1:]) for r in found)) == sorted(slow_print(t) for _, t in rows)


def test_pairs_within_eleven_bits_share_a_key():
    rng = random.Random(2)
    base = [rng.getrandbits(115) for _ in range(300)]
    other = []
    for x in base:
        for b in rng.sample(range(115), rng.randint(0, 11)):
            x ^= 1 << b
        other.append(x)
    keys = []
    for prints in (base, other):
        low, high = (np.array([p >> s & (1 << 64) - 1 for p in prints], np.uint64) for s in (0, 64))
        mine = [set() for _ in prints]
        for n, k in zip(*(x.tolist() for x in near_copies.keys(low, high, near_copies.PAIRS)), strict=True):
            mine[n].add(k)
        keys.append(mine)
    assert all(a & b for a, b in zip(*keys, strict=True))


def test_recall_at_a_similarity_of_0_8(spark, docs):
    """Pairs of any similarity from 0.8 up meet; unlike ones stay apart."""
    rng = random.Random(3)
    rows, near, far = [], [], []
    while len(near) < 250 or len(far) < 100:
        base = say(rng, rng.randrange(60, 300))
        copy = edited(rng, base, rng.randrange(1, 1 + len(base) // 12))
        s = similarity(base, copy)
        kind = near if s >= 0.8 else far if s <= 0.55 else None
        if kind is not None:
            kind.append(len(rows))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    got = dict(tuple(r) for r in near_copies.near_groups(docs(rows)).collect())
    recall = sum(got[i] == got[i + 1] for i in near) / len(near)
    assert recall >= 0.9, recall
    assert sum(got[i] == got[i + 1] for i in far) <= 1
    assert all(got[i] in (i, i - 1) for i in got)


def test_representatives_of_odd_tables(spark, docs):
    text = " ".join(say(random.Random(4), 30))
    df = docs([(4, text), (2, text + " more"), (3, "other words"), (9, None), (8, "")]).withColumn("_gone", F.lit("x"))
    got = near_copies.representatives(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [2, 3, 8]
    assert near_copies.representatives(docs([])).count() == 0
    assert near_copies.near_groups(docs([(1, "w " * 300_000)])).collect() == [(1, 1)]
