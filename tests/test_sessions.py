from __future__ import annotations

import pytest
from packets import (
    A, B, by_flow, frame, packet, random_packets, starts_any, starts_latest, tags, tags_any,
    udp_tags,
)
from pyspark.sql import functions as F

from wireloom.operators import direction, features, tcp, udp
from wireloom.plans.skew import CHUNK, find_splits, spread

CHUNKS = [None, 7]


def tagged(df) -> dict[int, int]:
    return {r["rowkey"]: r["sid_ts"] for r in df.select("rowkey", "sid_ts").collect()}


@pytest.mark.parametrize("rows_per_chunk", CHUNKS)
@pytest.mark.parametrize(("seed", "times"), [(1, 10_000), (2, 10_000), (3, 40), (4, 12)])
def test_tcp_tags_equal_brute_force(spark, seed, times, rows_per_chunk):
    rows = random_packets(seed, 300, times)
    df = frame(spark, rows)
    assert tagged(tcp.tag_sessions(df, rows_per_chunk)) == tags(rows)
    assert tagged(tcp.tag_any(df, rows_per_chunk)) == tags_any(rows)


@pytest.mark.parametrize("seed", [5, 6])
def test_handshakes_equal_brute_force(spark, seed):
    rows = random_packets(seed, 200, 5_000)
    df = frame(spark, rows)
    flows = by_flow(rows).values()
    latest = {r["start_ts"] for r in tcp.handshakes_latest(df).collect()}
    every = {r["start_ts"] for r in tcp.handshakes_any(df).collect()}
    assert latest == set().union(*(starts_latest(f) for f in flows))
    assert every == set().union(*(starts_any(f) for f in flows))
    assert latest <= every


@pytest.mark.parametrize("rows_per_chunk", CHUNKS)
@pytest.mark.parametrize(("gap", "times"), [(60, 5_000), (3, 60), (0, 30)])
def test_udp_tags_equal_brute_force(spark, gap, times, rows_per_chunk):
    rows = random_packets(7, 200, times, pr=17)
    df = frame(spark, rows)
    assert tagged(udp.tag_sessions(df, gap, rows_per_chunk=rows_per_chunk)) == udp_tags(rows, gap)


def test_hot_flow_is_cut_into_even_chunks(spark):
    rows = random_packets(8, 600, 10**6)
    df = spread(frame(spark, rows), tcp.FLOW, rows_per_chunk=50)
    sizes = [r["count"] for r in df.groupBy(*tcp.FLOW, CHUNK).count().collect()]
    assert max(sizes) <= 120 and len(sizes) > 8


def test_no_chunk_column_without_hot_keys(spark):
    df = frame(spark, random_packets(9, 100, 1000))
    assert find_splits(df, tcp.FLOW).cuts is None
    assert CHUNK not in spread(df, tcp.FLOW).columns


def test_retransmitted_syn_moves_the_start(spark):
    c, s = (A, 1000), (B, 80)
    rows = [
        packet(1, 10, c, s, 2, 5), packet(2, 20, c, s, 2, 5), packet(3, 30, s, c, 18, 9, 6),
        packet(4, 40, c, s, 16, 6, 10), packet(5, 50, c, s, 24, 6, 10, 30),
        packet(6, 60, s, c, 17, 10, 36), packet(7, 70, c, s, 16, 36, 11),
    ]
    df = frame(spark, rows)
    assert tagged(tcp.tag_sessions(df)) == {2: 20, 3: 20, 4: 20, 5: 20}
    assert [r["start_ts"] for r in tcp.handshakes_any(df).orderBy("start_ts").collect()] == [10, 20]


def test_half_open_and_reset_and_reuse(spark):
    c, s = (A, 1000), (B, 80)
    rows = [packet(1, 1, c, s, 2, 5), packet(2, 2, s, c, 18, 9, 6)]  # never acknowledged
    rows += [
        packet(3, 10, c, s, 2, 100), packet(4, 11, s, c, 18, 200, 101),
        packet(5, 12, c, s, 16, 101, 201), packet(6, 13, c, s, 20, 102, 201),
        packet(7, 14, s, c, 24, 201, 102, 9),
    ]
    rows += [
        packet(8, 20, c, s, 2, 300), packet(9, 21, s, c, 18, 400, 301),
        packet(10, 22, c, s, 16, 301, 401),
    ]
    expected = {3: 10, 4: 10, 5: 10, 8: 20, 9: 20, 10: 20}
    assert tagged(tcp.tag_sessions(frame(spark, rows))) == expected


def test_connection_of_an_endpoint_with_itself(spark):
    c = (A, 1000)
    rows = [packet(1, 1, c, c, 2, 5), packet(2, 2, c, c, 18, 9, 6), packet(3, 3, c, c, 16, 6, 10)]
    assert tagged(tcp.tag_sessions(frame(spark, rows))) == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("rows_per_chunk", CHUNKS)
def test_direction_follows_the_first_packet(spark, rows_per_chunk):
    rows = random_packets(10, 300, 3_000)
    df = tcp.tag_sessions(frame(spark, rows), rows_per_chunk)
    found = {
        r["rowkey"]: (r["direction"], r["server"])
        for r in direction.packet_directions(df).collect()
    }
    sent = {r["rowkey"]: r["client_sent"] for r in direction.client_side(df).collect()}
    expected = {}
    tag = tags(rows)
    for flow in by_flow(rows).values():
        first = {}
        for r in flow:
            if r[0] not in tag:
                continue
            head = first.setdefault(tag[r[0]], r)
            ip, port = head[5:7]
            server = ip * 65536 + port - (1 << 48 if ip >= 1 << 31 else 0)
            way = "forward" if r[3:7] == head[3:7] else "back"
            expected[r[0]] = (way, server)
    assert found == expected
    assert sent == {k: way == "forward" for k, (way, _) in expected.items()}


def brute_features(rows: list[tuple]) -> dict[str, float]:
    """The 44 values of one session from its packets in order."""

    def stats(sizes, times, plds, whole):
        out = {}
        gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
        for name, xs in (("pkt_len", sizes), ("ts_IAT", gaps), ("pld_len", plds)):
            avg = sum(xs) // len(xs) if xs else 0
            if name == "pkt_len" and whole:
                var = sum((x - avg) ** 2 for x in xs) / avg
            elif name == "pkt_len":
                var = sum((x - avg) ^ 2 for x in xs) / len(xs) if xs else 0
            else:
                var = sum((x - avg) ** 2 for x in xs) / len(xs) if xs else 0
            values = (avg, min(xs, default=0), max(xs, default=0), var)
            out |= {f"{s}_{name}": v for s, v in zip(("avg", "min", "max", "var"), values, strict=True)}
        out["total_bytes"] = sum(sizes)
        return out

    def side(of, prefix):
        plds = [r[10] for r in of if r[10] > 0]
        got = stats([r[11] for r in of], [r[1] for r in of], plds, False)
        got["pkt_cnt"] = len(of)
        return {f"{prefix}_{k}": v for k, v in got.items()}

    times = [r[1] for r in rows]
    out = stats([r[11] for r in rows], times, [r[10] for r in rows], True)
    out |= {
        "sessn_dur": max(times) - min(times),
        "pkts_cnt": len(rows),
        "psh_cnt": sum(bool(r[7] & 8) for r in rows),
    }
    way = rows[0][3:7]
    out |= side([r for r in rows if r[3:7] != way], "sc")
    return out | side([r for r in rows if r[3:7] == way], "cs")


@pytest.mark.parametrize("rows_per_chunk", CHUNKS)
@pytest.mark.parametrize(("seed", "times"), [(11, 4_000), (12, 10**14), (13, 25)])
def test_features_equal_brute_force(spark, seed, times, rows_per_chunk):
    rows = random_packets(seed, 400, times)
    df = tcp.tag_sessions(frame(spark, rows), rows_per_chunk)
    tag = tags(rows)
    expected = {}
    for flow, packets in by_flow(rows).items():
        sessions = {}
        for r in packets:
            if r[0] in tag:
                sessions.setdefault(tag[r[0]], []).append(r)
        for ts, members in sessions.items():
            expected[(flow[0][1] if flow[0][0] == A else flow[1][1], ts)] = brute_features(members)
    found = {}
    for r in features.session_features_wide(df).collect():
        port = next(k & 65535 for k in (r["lo"], r["hi"]) if (k >> 16) == A)
        found[(port, r["sid_ts"])] = {name: r[name] for name in features.FEATURES}
    assert found.keys() == expected.keys()
    assert any(v["pkts_cnt"] == 1 or v["sc_pkt_cnt"] == 0 for v in expected.values()) or seed > 11
    for key, values in expected.items():
        for name, v in values.items():
            assert found[key][name] == pytest.approx(v, rel=1e-12), (key, name)


def test_one_packet_and_one_sided_sessions(spark):
    c, s = (A, 1000), (B, 80)
    rows = [packet(1, 5, c, s, 24, 1, 1, 7)]
    one = frame(spark, rows).withColumn("sid_ts", F.lit(5).cast("bigint"))
    got = features.session_features_wide(one).collect()[0].asDict()
    assert {k: got[k] for k in features.FEATURES} == pytest.approx(brute_features(rows))
    rows = [packet(1, 5, c, s, 24, 1, 1, 7), packet(2, 9, c, s, 16, 1, 1)]
    one = frame(spark, rows).withColumn("sid_ts", F.lit(5).cast("bigint"))
    got = features.session_features_wide(one).collect()[0].asDict()
    assert {k: got[k] for k in features.FEATURES} == pytest.approx(brute_features(rows))
    assert [r["side"] for r in features.direction_statistics(one).collect()] == ["cs"]


def test_corrected_variances(spark):
    rows = random_packets(14, 200, 4_000)
    df = tcp.tag_sessions(frame(spark, rows))
    got = features.session_features_wide(df, corrected=True).collect()
    tag = tags(rows)
    sizes = {}
    for r in rows:
        if r[0] in tag:
            sizes.setdefault(tag[r[0]], []).append(r[11])
    for r in got:
        xs = sizes[r["sid_ts"]]
        avg = sum(xs) // len(xs)
        assert r["var_pkt_len"] == pytest.approx(sum((x - avg) ** 2 for x in xs) / len(xs))


def test_feature_names_and_invariants(spark):
    assert len(features.FEATURES) == len(set(features.FEATURES)) == 44
    df = frame(spark, random_packets(15, 300, 4_000))
    done = tcp.tag_sessions(df)
    table = features.session_features(done)
    assert done.count() <= df.count()
    assert table.count() <= done.count()
    row = table.first()
    assert len(row["features_value"]) == len(row["features_name"]) == 44
    assert len(row["m"]) == 7 and len(row["direction"]) == 13 and len(row["rowkey"]) == 16
