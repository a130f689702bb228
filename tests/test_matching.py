from __future__ import annotations

import random
from collections import Counter

import pytest
from conftest import plan_text
from pyspark.sql import functions as F

from wireloom.functions.ratios import feature_ratio
from wireloom.operators import clusters, matching, models, profiles
from wireloom.operators.features import FEATURES
from wireloom.plans.numbering import number_by_hash
from wireloom.sources.tables import PROFILES

NAMES = list(FEATURES)
TABLE = "rowkey binary, m binary, features_name array<string>, features_value array<struct<frac:double,mean:double>>"


def random_profile(rng: random.Random) -> list[tuple[float, float | None]]:
    base = rng.choice([1.0, 1.5, 2.0, 8.0])
    out = []
    for _ in NAMES:
        kind = rng.random()
        if kind < 0.06:
            out.append((0.0 if kind < 0.05 else 0.9, None))
        elif kind < 0.15:
            out.append((rng.choice([0.5, 1.0]), 0.0))
        else:
            sign = -1 if kind > 0.97 else 1
            out.append((rng.choice([0.3, 0.5, 1.0]), sign * base * rng.uniform(0.5, 1.6)))
    return out


def table(spark, vectors):
    import hashlib

    rows = []
    for i, v in enumerate(vectors):
        m = i.to_bytes(7, "big")
        rows.append((hashlib.md5(m).digest(), m, NAMES, v))
    return spark.createDataFrame(rows, TABLE)


def ratio(a, b):
    if a is None or b is None or (a == 0 and b == 0):
        return 1.0
    return 0.0 if b == 0 else a / b


def top10(vector):
    return sorted(range(len(vector)), key=lambda i: (vector[i][0], i), reverse=True)[:10]


def brute(probe, reference, band):
    agree = 0
    for i in top10(reference):
        a, b = probe[i][1], reference[i][1]
        if not band.probe_on_top:
            a, b = b, a
        agree += band.low <= ratio(a, b) <= band.high
    return agree >= 8


@pytest.mark.parametrize("band", [models.TRAINING, models.IDENTIFY, clusters.CLUSTERING])
@pytest.mark.parametrize("few", [0, 10_000])
def test_matching_pairs_equal_brute_force(spark, band, few, monkeypatch):
    monkeypatch.setattr(matching, "ROWS_PER_BUCKET", 5)
    monkeypatch.setattr(matching, "FEW", few)
    rng = random.Random(3)
    vectors = [random_profile(rng) for _ in range(60)]
    df = table(spark, vectors)
    key = F.conv(F.hex("m"), 16, 10).cast("int")
    probes = df.select(
        key.alias("probe"), matching.profile_means(F.col("features_value")).alias("means")
    )
    refs = matching.reference_table(df.withColumn("k", key), "k")
    got = {tuple(r) for r in matching.matching_pairs(probes, refs, band).collect()}
    expected = {
        (p, r)
        for p, a in enumerate(vectors)
        for r, b in enumerate(vectors)
        if brute(a, b, band)
    }
    assert len(expected) > 60
    assert got == expected
    label = F.pmod(F.xxhash64("m"), F.lit(3)).alias("label")
    sides = {r["k"]: r["label"] for r in df.select(key.alias("k"), label).collect()}
    labels = df.select(key.alias("k"), label)
    crossing = matching.matching_pairs(
        probes.join(labels, probes["probe"] == labels["k"]).drop("k"),
        refs.join(labels, refs["ref"] == labels["k"]).drop("k"),
        band,
        across="label",
    )
    assert {tuple(r) for r in crossing.collect()} == {
        (p, r) for p, r in expected if sides[p] != sides[r]
    }
    first = {}
    for p, r in sorted(expected):
        first.setdefault(p, r)
    rows = matching.first_match(probes, refs, band).collect()
    assert len(rows) == 60
    assert {r["probe"]: r["ref"] for r in rows} == {p: first.get(p) for p in range(60)}


@pytest.mark.parametrize("pairs_per_meeting", [0, 64])
def test_keys_and_cells_find_the_same(spark, pairs_per_meeting, monkeypatch):
    for name, value in (("FEW", 7), ("ROWS_PER_CELL", 16), ("PAIRS_PER_MEETING", pairs_per_meeting)):
        monkeypatch.setattr(matching, name, value)
    rng = random.Random(12)
    vectors = [random_profile(rng) for _ in range(50)]
    vectors += [[(f, float("nan") if i % 9 == 0 else x) for i, (f, x) in enumerate(v)] for v in vectors[:5]]
    vectors += [[(1.0, float("nan"))] * len(NAMES)]
    df = table(spark, vectors).withColumn("k", F.conv(F.hex("m"), 16, 10).cast("int"))
    side = F.when(F.col("k") % 3 > 0, F.lit("a")).otherwise(F.col("k").cast("string")).alias("side")
    probes = df.select(F.col("k").alias("probe"), side, matching.profile_means(F.col("features_value")).alias("means"))
    refs = matching.reference_table(df, "k").join(df.select(F.col("k").alias("ref"), side), "ref")
    band = models.IDENTIFY
    want = {(p, r) for p, a in enumerate(vectors) for r, b in enumerate(vectors) if brute(a, b, band)}
    first = {p: min((r for q, r in want if q == p), default=None) for p in range(len(vectors))}
    got = matching.first_match(probes, refs, band).collect()
    assert {r["probe"]: r["ref"] for r in got} == first and len(got) == len(vectors)
    assert None in first.values() and max(r or 0 for r in first.values()) >= 7

    def of(k):
        return "a" if k % 3 else str(k)

    crossing = [tuple(r) for r in matching.matching_pairs(probes, refs, band, across="side").collect()]
    apart = {(p, r) for p, r in want if of(p) != of(r)}
    assert set(crossing) == apart and len(crossing) == len(apart)

    def parts(pairs):
        names = {of(k): of(k) for k in range(len(vectors))}
        for p, r in pairs:
            a, b = names[of(p)], names[of(r)]
            names = {k: a if v == b else v for k, v in names.items()}
        return {frozenset(k for k in names if names[k] == v) for v in names.values()}

    joined = {tuple(r) for r in matching.matching_pairs(probes, refs, band, across="side", joining=True).collect()}
    assert joined <= apart and parts(joined) == parts(apart)


def test_most_pairs_are_compared_in_tasks_and_not_stored(spark, monkeypatch):
    """Features that tell little apart: pairs that share a rare key were shuffled, nearly all of them."""
    monkeypatch.setattr(matching, "FEW", 5)
    rng = random.Random(13)
    vectors = [[(1.0, rng.choice([-1, 1]) * rng.uniform(1, 4)) for _ in NAMES] for _ in range(80)]
    df = table(spark, vectors)
    probes = df.select(F.col("m").alias("probe"), matching.profile_means(F.col("features_value")).alias("means"))
    text = plan_text(matching.first_match(probes, matching.reference_table(df, "m"), models.TRAINING))
    assert "means" in text and "FlatMapGroupsInArrow" in text and "Join" not in text


def test_reference_without_known_features_matches_all(spark):
    blank = [(1.0, None)] * 10 + [(0.0, 1.0)] * 34
    rng = random.Random(4)
    vectors = [blank] + [random_profile(rng) for _ in range(5)]
    df = table(spark, vectors)
    key = F.hex("m")
    probes = df.select(
        key.alias("probe"), matching.profile_means(F.col("features_value")).alias("means")
    )
    refs = matching.reference_table(df.withColumn("k", key), "k")
    rows = matching.first_match(probes, refs, models.TRAINING).collect()
    assert {r["ref"] for r in rows} == {"0" * 14}
    labels = clusters.cluster_profiles(df).collect()
    assert {r["cluster_id"] for r in labels} == {0}


def test_top_features_prefer_later_positions(spark):
    vector = [(0.5, float(i)) for i in range(44)]
    vector[3] = (0.9, 3.0)
    rows = profiles.top_features_long(table(spark, [vector]), "m").orderBy("rank").collect()
    assert [r["pos"] for r in rows] == [3, *range(43, 34, -1)]
    assert rows[0]["name"] == NAMES[3] and rows[0]["rank"] == 1


def test_ratio_guards(spark):
    rows = [(None, 1.0), (1.0, None), (0.0, 0.0), (5.0, 0.0), (0.0, 5.0), (3.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = [r[0] for r in df.select(feature_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 1.0, 1.0, 0.0, 0.0, 1.5]


def session_rows(spark, groups):
    rows = [(m, NAMES, v) for m, vectors in groups.items() for v in vectors]
    return spark.createDataFrame(
        rows, "m binary, features_name array<string>, features_value array<double>"
    )


@pytest.mark.parametrize("rows_per_chunk", [10**6, 3])
def test_profiles_equal_brute_force(spark, rows_per_chunk):
    rng = random.Random(5)
    groups = {
        b"hot": [[rng.choice([0.1, 1.0, 5.0, 40.0]) for _ in NAMES] for _ in range(30)],
        b"one": [[float(i) for i in range(44)]],
        b"two": [[1.0] * 44, [3.0] * 44],
        b"same": [[0.1] * 44] * 7,
    }
    got = profiles.profile_features(session_rows(spark, groups), "m", rows_per_chunk).collect()
    assert len(got) == 4 * 44
    for r in got:
        xs = [v[r["pos"]] for v in groups[bytes(r["m"])]]
        avg = sum(xs) / len(xs)
        dev = (sum((x - avg) ** 2 for x in xs) / len(xs)) ** 0.5
        kept = [x for x in xs if abs(x - avg) <= 0.5 * dev + 1e-9 * max(abs(avg), 1)]
        assert r["frac"] == len(kept) / len(xs)
        assert r["name"] == NAMES[r["pos"]]
        assert (r["mean"] is None) == (not kept)
        if kept:
            assert r["mean"] == pytest.approx(sum(kept) / len(kept))
    empty = [r for r in got if bytes(r["m"]) == b"two"]
    assert all(r["frac"] == 0 and r["mean"] is None for r in empty)


def test_profile_table_round_trip(spark):
    wide = profiles.profiles_wide(
        profiles.profiles(session_rows(spark, {b"a": [[2.0] * 44, [2.0] * 44]}))
    )
    row = wide.first()
    assert row["avg_pkt_len"]["frac"] == 1.0 and row["cs_pkt_cnt"]["mean"] == 2.0


def test_training_numbers_new_models_after_the_highest(spark):
    rng = random.Random(6)
    low = [(1.0, rng.uniform(1, 1.2)) for _ in NAMES]
    high = [(1.0, 900.0 * (i + 1)) for i in range(44)]
    negative = [(1.0, -5.0)] * 44
    candidates = table(spark, [low, high, negative])
    known = table(spark, [low]).select(
        F.lit("WX007").alias("id"), "features_name", "features_value",
        F.lit(None).cast("string").alias("keywords"),
    )
    assigned, used = models.train_models(candidates, known)
    by_m = {
        bytes(r["m"])[-1]: r["id"]
        for r in candidates.join(assigned, "rowkey").select("m", "id").collect()
    }
    assert by_m[0] == "WX007"
    assert sorted([by_m[1], by_m[2]]) == ["WX008", "WX009"]
    assert sorted(r["id"] for r in used.collect()) == ["WX007", "WX008", "WX009"]


def test_training_from_nothing_starts_at_zero(spark):
    candidates = table(spark, [[(1.0, 1.0)] * 44])
    none = spark.createDataFrame(
        [], "id string, features_name array<string>, "
        "features_value array<struct<frac:double,mean:double>>, keywords string",
    )
    assigned, used = models.train_models(candidates, none)
    assert [r["id"] for r in assigned.collect()] == ["WX000"]
    assert used.count() == 1
    assert set(none.columns) < set(PROFILES.names)


def test_unknown_session_gives_no_row(spark):
    from wireloom.plans import jobs

    known = table(spark, [[(1.0, 1.0)] * 44]).withColumn("id", F.lit("WX000"))
    sessions = session_rows(spark, {b"a": [[1.0] * 44]}).withColumn("rowkey", F.lit(b"\x01"))
    assert [r["id"] for r in jobs.identify(sessions, known, "01").collect()] == ["WX000"]
    assert jobs.identify(sessions, known, "02").count() == 0


def test_numbering_follows_key_order(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k"))
    rows = number_by_hash(df, "k", "n").collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: r["k"])] == list(range(500))


def test_components_of_chain_star_and_loners(spark):
    chain = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(60)]
    star = [("b000", f"b{i:03d}") for i in range(1, 40)]
    nodes = sorted({n for e in chain + star for n in e} | {"c", "d"})
    labels = clusters.connected_components(
        spark.createDataFrame([(n,) for n in nodes], "node string"),
        spark.createDataFrame(chain + star, "src string, dst string"),
    ).collect()
    assert {r["node"]: r["component"] for r in labels} == {
        n: {"a": "a000", "b": "b000"}.get(n[0], n) for n in nodes
    }


@pytest.mark.parametrize("leaders", [32, 1])
def test_clusters_equal_brute_force(spark, leaders, monkeypatch):
    monkeypatch.setattr(clusters.leader_edges, "__defaults__", (2, leaders))
    rng = random.Random(8)
    vectors = [random_profile(rng) for _ in range(30)]
    vectors += [vectors[0]] * 12  # copies
    df = table(spark, vectors)
    band = clusters.CLUSTERING
    parent = list(range(len(vectors)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors):
            if i != j and (a == b or brute(a, b, band)):
                parent[root(i)] = root(j)
    rows = df.join(clusters.cluster_profiles(df), "rowkey").select("m", "cluster_id").collect()
    got = {int.from_bytes(r["m"], "big"): r["cluster_id"] for r in rows}
    assert len(got) == len(vectors)
    for i in got:
        for j in got:
            assert (got[i] == got[j]) == (root(i) == root(j))
    members = clusters.cluster_members(clusters.cluster_profiles(df)).collect()
    assert len(members) == len(vectors) == len({bytes(r["rowkey"]) for r in members})
    assert {r["cluster_id"]: r["members"] for r in members} == dict(Counter(got.values()))


@pytest.mark.parametrize(("leaders", "rounds"), [(1, 1), (2, 2), (3, 40)])
def test_pivot_clusters_equal_brute_force(spark, leaders, rounds, monkeypatch):
    import hashlib

    monkeypatch.setattr(clusters, "LEADERS", leaders)
    monkeypatch.setattr(clusters, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(clusters, "WORTHWHILE", 0)
    rng = random.Random(9)
    vectors = [random_profile(rng) for _ in range(25)]
    # A chain: each resembles the next one only.
    vectors += [[(1.0, 10.0 * 1.9**i)] * len(NAMES) for i in range(9)] + [vectors[3]] * 5
    df = table(spark, vectors)
    keys = [hashlib.md5(i.to_bytes(7, "big")).hexdigest() for i in range(len(vectors))]
    order = sorted(range(len(vectors)), key=lambda i: hashlib.md5(f"42|{keys[i]}".encode()).hexdigest())

    def alike(a, b):
        return a == b or brute(a, b, clusters.CLUSTERING) or brute(b, a, clusters.CLUSTERING)

    pivots, want = [], {}
    for i in order:
        near = [p for p in pivots if alike(vectors[i], vectors[p])]
        if not near:
            pivots.append(i)
        want[keys[i]] = keys[near[0] if near else i]
    numbers = {p: n for n, p in enumerate(sorted({keys[p] for p in pivots}))}
    got = {r["rowkey"].hex(): (r["pivot"].hex(), r["cluster_id"]) for r in clusters.pivot_clusters(df).collect()}
    assert got == {k: (p, numbers[p]) for k, p in want.items()}
    assert 1 < len(pivots) < len(vectors)


def test_pivot_clusters_of_no_profiles(spark):
    assert clusters.pivot_clusters(table(spark, [])).count() == 0
