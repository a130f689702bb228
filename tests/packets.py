"""Packet rows and brute-force models for the tests."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

from wireloom.functions.addresses import with_flow_key

SCHEMA = (
    "rowkey bigint, t bigint, pr int, si bigint, sp int, di bigint, dp int, "
    "tcp_flags int, seq bigint, ack bigint, pld_len int, pkt_len int"
)
A, B, C = 0x0A000001, 0xAC100002, 0x0A000003


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return with_flow_key(spark.createDataFrame(rows, SCHEMA))


def packet(key, t, src, dst, flags, seq=0, ack=0, pld=0, pr=6):
    (si, sp), (di, dp) = src, dst
    return (key, t, pr, si, sp, di, dp, flags, seq, ack, pld, 54 + pld)


def random_packets(seed: int, n: int, spread: int, flows: int = 3, pr: int = 6) -> list[tuple]:
    """Handshake-heavy packets; a small ``spread`` of times makes many ties."""
    rng = random.Random(seed)
    ends = [((A, 1000 + i), (B, 80)) for i in range(flows)]
    rows = []
    for key in range(n):
        client, server = ends[0] if rng.random() < 0.6 else rng.choice(ends)
        back = rng.random() < 0.5
        src, dst = (server, client) if back else (client, server)
        isn, sisn = rng.choice([10, 20]), rng.choice([50, 60])
        kind = rng.choice(["syn", "synack", "ack", "data", "push", "fin", "rst"])
        flags, seq, ack = {
            "syn": (2, isn, 0),
            "synack": (18, sisn, isn + 1),
            "ack": (16, isn + 1, sisn + 1),
            "data": (16, isn + 500, sisn + 9),
            "push": (24, isn + 600, sisn + 9),
            "fin": (17, isn + 700, sisn + 9),
            "rst": (4, isn + 800, 0),
        }[kind]
        pld = rng.choice([0, 0, 3, 120]) if kind in ("data", "push") else 0
        rows.append(packet(key, rng.randrange(spread), src, dst, flags, seq, ack, pld, pr))
    return rows


def by_flow(rows: list[tuple]) -> dict[tuple, list[tuple]]:
    groups = defaultdict(list)
    for r in rows:
        ends = sorted([(r[3], r[4]), (r[5], r[6])])
        groups[(*ends, r[2])].append(r)
    return {k: sorted(v, key=lambda r: (r[1], r[0])) for k, v in groups.items()}


def starts_latest(flow: list[tuple]) -> set[int]:
    """Start times: each ACK names its latest SYN-ACK, that one its latest SYN."""
    found = set()
    taken: dict[int, int | None] = {}
    for i, r in enumerate(flow):
        key, t, _, si, sp, di, dp, flags, seq, ack, *_ = r
        earlier = flow[:i]
        if flags == 18:
            syns = [
                e[1] for e in earlier
                if e[7] == 2 and e[9] == 0 and e[8] == ack - 1 and e[3:7] == (di, dp, si, sp)
            ]
            taken[key] = syns[-1] if syns else None
        if flags == 16:
            answers = [
                taken[e[0]] for e in earlier
                if e[7] == 18 and e[9] == seq and e[8] == ack - 1
                and e[3:7] == (di, dp, si, sp) and taken[e[0]] is not None
            ]
            if answers:
                found.add(answers[-1])
    return found


def starts_any(flow: list[tuple]) -> set[int]:
    found = set()
    for s in (r for r in flow if r[7] == 2):
        for a in flow:
            if a[7] != 18 or a[9] != s[8] + 1 or a[1] < s[1] or a[3:7] != (*s[5:7], *s[3:5]):
                continue
            if any(
                k[7] == 16 and k[9] == a[8] + 1 and k[8] == a[9] and k[1] >= a[1]
                and k[3:7] == s[3:7]
                for k in flow
            ):
                found.add(s[1])
    return found


def tags(rows: list[tuple]) -> dict[int, int]:
    """Packet key to session time, method 2."""
    out = {}
    for flow in by_flow(rows).values():
        starts = starts_latest(flow)
        stops = {r[1] for r in flow if r[7] & 5}
        for r in flow:
            start = max((s for s in starts if s <= r[1]), default=None)
            stop = max((s for s in stops if s <= r[1]), default=-1)
            if start is not None and start > stop:
                out[r[0]] = start
    return out


def tags_any(rows: list[tuple]) -> dict[int, int]:
    out = {}
    for flow in by_flow(rows).values():
        starts = starts_any(flow)
        for r in flow:
            start = max((s for s in starts if s <= r[1]), default=None)
            if start is not None:
                out[r[0]] = start
    return out


def udp_tags(rows: list[tuple], gap: int) -> dict[int, int]:
    out = {}
    for flow in by_flow(rows).values():
        current = flow[0][1]
        for prev, r in zip([None, *flow], flow, strict=False):
            if prev is not None and r[1] - prev[1] > gap:
                current = prev[1]
            out[r[0]] = current
    return out
