from __future__ import annotations

import base64
import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import plan_text

from wireloom.functions import trigrams
from wireloom.operators import keywords

SCHEMA = "m string, sid bigint, direction string, payload binary"


def make_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for m in ("web", "dns"):
        for sid in range(12):
            way = rng.choice(["forward", "back"])
            for _ in range(rng.randrange(1, 4)):
                body = b"GET /" + bytes(rng.choices(range(250, 256), k=3)) + rng.choice([b"", b"HTTP"])
                rows.append((m, sid, way, body[: rng.randrange(0, 14)]))
    return rows


def brute_shares(rows) -> dict[tuple, float]:
    plds, counts = Counter(), Counter()
    for m, sid, way, body in rows:
        plds[m, sid, way] += 1
        for i in range(len(body) - 3):
            counts[m, sid, way, body[i : i + 3].hex().upper()] += 1
    shares = {k: n / plds[k[:3]] for k, n in counts.items()}
    return {k: s for k, s in shares.items() if 0.5 <= s <= 1.0}


def transactions(shares) -> dict[tuple, dict[int, set]]:
    groups = defaultdict(lambda: defaultdict(set))
    for m, sid, way, item in shares:
        groups[m, way][sid].add(item)
    return groups


def brute_sets(baskets: list[set], support: float, sizes) -> dict[tuple, int]:
    least = -(-len(baskets) * support // 1)
    items = sorted(set().union(*baskets))
    out = {}
    for size in sizes:
        for combo in itertools.combinations(items, size):
            freq = sum(set(combo) <= b for b in baskets)
            if freq >= least and freq > 0:
                out[combo] = freq
    return out


def test_trigrams_leave_out_the_last(spark):
    bodies = [b"", b"abc", b"abcd", b"abcdef", bytes(range(250, 256))]
    df = spark.createDataFrame([(b,) for b in bodies], "payload binary")
    rows = df.select(
        "payload",
        trigrams.trigrams(F.col("payload")).alias("t"),
        trigrams.byte_slices(F.col("payload"), 3).alias("s"),
    ).collect()
    for r in rows:
        b = bytes(r["payload"])
        assert r["t"] == [b[i : i + 3].hex().upper() for i in range(len(b) - 3)]
        assert r["s"] == [b[i : i + 3].hex().upper() for i in range(len(b) - 2)]


def test_shares_and_sets_equal_brute_force(spark):
    rows = make_rows()
    df = spark.createDataFrame([*rows, (None, 1, "forward", b"x"), ("web", 1, None, b"x")], SCHEMA)
    shares = keywords.keyword_shares(df)
    got = {(r["m"], r["sid"], r["direction"], r["item"]): r["share"] for r in shares.collect()}
    expected = brute_shares(rows)
    assert got == pytest.approx(expected) and len(got) > 50
    sessions = keywords.sessions(df)
    wanted = {}
    for (m, way), kept in transactions(expected).items():
        every = len({sid for m2, sid, way2, _ in rows if (m2, way2) == (m, way)})
        baskets = [*kept.values(), *[set()] * (every - len(kept))]
        for combo, freq in brute_sets(baskets, 0.2, (1, 2)).items():
            wanted[m, way, combo] = freq
    sets = keywords.frequent_sets(shares, sessions, max_size=2).collect()
    assert {(r["m"], r["direction"], tuple(r["items"])): r["freq"] for r in sets} == wanted


@pytest.mark.parametrize("step", [1, 60, 1 << 20])
@pytest.mark.parametrize("most", [0, 20, 1 << 20])
def test_shares_of_sessions_in_any_steps(spark, monkeypatch, step, most):
    rows = [*make_rows(3), ("web", 99, "back", b"")]
    monkeypatch.setattr(keywords, "BYTES_PER_STEP", step)
    shares = keywords.keyword_shares(spark.createDataFrame(rows, SCHEMA), most=most).collect()
    got = {(r["m"], r["sid"], r["direction"], r["item"]): r["share"] for r in shares}
    assert got == pytest.approx(brute_shares(rows)) and len(got) == len(shares) > 50


def test_trigrams_do_not_move(spark):
    """Payloads go to their sessions; trigrams are counted behind that shuffle."""
    plan = plan_text(keywords.keyword_shares(spark.createDataFrame(make_rows(), SCHEMA)))
    assert "hashpartitioning(gram" not in plan and "Generate" not in plan
    assert "MapInArrow" in plan and plan.count("Exchange hashpartitioning") == 1


def test_groups_are_mined_in_tasks_of_their_own(spark):
    rows = [(m, sid, "back", item, 1.0) for m in "abcdefghijkl" for sid, b in enumerate(("AB", "A")) for item in b]
    shares = spark.createDataFrame(rows, SHARES)
    sessions = shares.select("m", "sid", "direction").distinct()
    for find in (keywords.closed_sets, keywords.frequent_sets):
        tasks = find(shares, sessions).select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 3


def test_closed_sets_of_repeated_transactions(spark):
    rng = random.Random(8)
    kinds = [{i for i in "ABCDEF" if rng.random() < 0.7} for _ in range(6)]
    baskets = [b for n, b in enumerate(kinds) for _ in range(2 * n + 1)]
    shares, sessions = baskets_of(spark, baskets)
    wanted = {("m", c): f for c, f in brute_sets(baskets, 0.2, range(1, 7)).items()}
    closed = {k for k, f in wanted.items() if not any(set(k[1]) < set(o[1]) and f == g for o, g in wanted.items())}
    assert mined(keywords.closed_sets(shares, sessions)) == {k: wanted[k] for k in closed}


SHARES = "m string, sid bigint, direction string, item string, share double"


def baskets_of(spark, baskets, m="m"):
    """Shares and sessions of a list of item sets, empty ones included."""
    rows = [(m, sid, "back", item, 1.0) for sid, b in enumerate(baskets) for item in b]
    sessions = [(m, sid, "back") for sid in range(len(baskets))]
    return spark.createDataFrame(rows, SHARES), spark.createDataFrame(sessions, SHARES.partition(", item")[0])


def mined(sets):
    return {(r["m"], tuple(r["items"])): r["freq"] for r in sets.collect()}


def test_sets_of_every_size(spark):
    rng = random.Random(4)
    shares = sessions = None
    wanted = {}
    for m, n, low in (("a", 30, 0.3), ("b", 7, 0.3), ("c", 1, 0.3)):
        baskets = [{i for i in "ABCDEFG" if rng.random() < 0.8} for _ in range(n)]
        one, all_ = baskets_of(spark, baskets, m)
        shares = one if shares is None else shares.union(one)
        sessions = all_ if sessions is None else sessions.union(all_)
        wanted |= {(m, c): f for c, f in brute_sets(baskets, low, range(1, 8)).items()}
    assert max(len(c) for _, c in wanted) > 3
    assert mined(keywords.frequent_sets(shares, sessions, 0.3)) == wanted
    assert mined(keywords.frequent_sets(shares, sessions, 0.3, max_size=9)) == wanted
    three = {k: f for k, f in wanted.items() if len(k[1]) <= 3}
    assert mined(keywords.frequent_sets(shares, sessions, 0.3, max_size=3)) == three


@pytest.mark.parametrize("room", [1, 12, 60])
def test_large_shards_are_split(spark, monkeypatch, room):
    rng = random.Random(room)
    baskets = [{i for i in "ABCDEFGH" if rng.random() < 0.7} for _ in range(25)] + [{"A", "B"}] * 15
    shares, sessions = baskets_of(spark, baskets)
    monkeypatch.setattr(keywords, "ITEMS_PER_SHARD", room)
    wanted = {("m", c): f for c, f in brute_sets(baskets, 0.2, range(1, 9)).items()}
    sets = keywords.frequent_sets(shares, sessions)
    rows = sets.collect()
    assert mined(sets) == wanted and len(rows) == len(wanted)
    closed = {k for k, f in wanted.items() if not any(set(k[1]) < set(o[1]) and f == g for o, g in wanted.items())}
    assert set(mined(keywords.closed_of(sets))) == closed and 0 < len(closed) < len(wanted)
    got = keywords.closed_sets(shares, sessions)
    assert mined(got) == {k: wanted[k] for k in closed} and got.count() == len(closed)
    monkeypatch.setattr(keywords, "ITEMS_PER_SHARD", 1000)
    got = keywords.closed_sets(shares, sessions)
    assert mined(got) == {k: wanted[k] for k in closed} and got.count() == len(closed)


def test_empty_sessions_count_towards_support(spark):
    shares, sessions = baskets_of(spark, [{"A"}, {"B"}] + [set()] * 8)
    assert keywords.frequent_sets(shares, sessions).count() == 0
    assert keywords.best_sets(shares, sessions).count() == 0
    shares, sessions = baskets_of(spark, [{"A"}, {"A"}] + [set()] * 8)
    assert mined(keywords.frequent_sets(shares, sessions)) == {("m", ("A",)): 2}


def test_equal_items_all_stay(spark):
    for n in (12, 300):
        items = {f"{i:06X}" for i in range(n)}
        shares, sessions = baskets_of(spark, [items] * 5)
        words = keywords.keywords(shares, sessions).collect()[0]["keywords"].split(",")
        assert len(words) == n
        assert [r["size"] for r in keywords.best_sets(shares, sessions).orderBy("place").collect()] == [n] + [n - 1] * 9


def test_best_sets_equal_the_definition(spark):
    for seed in range(12):
        rng = random.Random(seed)
        pool = ["AAA", "AAB", "AAC", "BBB", "BBC", "CCC", "DDD"]
        twins = rng.randint(0, 4)
        baskets = []
        for _ in range(rng.choice([1, 5, 12])):
            b = {i for i in pool if rng.random() < rng.choice([0.3, 0.8])}
            if "AAA" in b:
                b |= {f"A{t}" for t in range(twins)}
            baskets.append(b - {f"A{t}" for t in range(twins)} if "AAA" not in b else b)
        shares, sessions = baskets_of(spark, baskets)
        sets = brute_sets(baskets, 0.2, range(1, 12))
        best = sorted(sets, key=lambda c: (-sets[c], -len(c), c))[:10]
        got = keywords.best_sets(shares, sessions).orderBy("place").collect()
        assert [tuple(r["items"]) for r in got] == best
        assert [r["freq"] for r in got] == [sets[c] for c in best]


def test_keywords_come_from_the_ten_best_sets(spark):
    rows = make_rows(2)
    shares = brute_shares(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    sessions = keywords.sessions(df)
    got = {(r["m"], r["direction"]): r for r in keywords.keywords(keywords.keyword_shares(df), sessions).collect()}
    counts = {(r["m"], r["direction"]): r["count"] for r in sessions.groupBy("m", "direction").count().collect()}
    for (m, way), kept in transactions(shares).items():
        baskets = list(kept.values()) + [set()] * (counts[m, way] - len(kept))
        sets = brute_sets(baskets, 0.2, range(1, 3))
        if max(map(len, brute_sets(baskets, 0.2, range(3, 4))), default=0):
            continue
        best = sorted(sets, key=lambda c: (-sets[c], -len(c), c))[:10]
        items = sorted(set(itertools.chain(*best)))
        words = ",".join(base64.b64encode(bytes.fromhex(i)).decode() for i in items)
        assert got[m, way]["keywords"] == words
        assert bytes(got[m, way]["rowkey"]) == hashlib.md5(m.encode()).digest()


def test_sample_keeps_whole_sessions_and_repeats(spark):
    rows = [("m", sid, "back", item, 1.0) for sid in range(2000) for item in "AB"]
    shares = spark.createDataFrame(
        rows, "m string, sid bigint, direction string, item string, share double"
    )
    one = keywords.sample_transactions(shares, 0.05).groupBy("sid").count().collect()
    two = keywords.sample_transactions(shares.repartition(5), 0.05).groupBy("sid").count().collect()
    assert sorted(one) == sorted(two)
    assert 60 <= len(one) <= 140 and {r["count"] for r in one} == {2}
    assert keywords.sample_transactions(shares, 1.0).count() == 4000


def test_endpoint_directions(spark):
    df = spark.createDataFrame(make_rows(), SCHEMA)
    got = {tuple(r) for r in keywords.endpoint_directions(df).collect()}
    assert got == {(m, way) for m, _, way, _ in make_rows()}
