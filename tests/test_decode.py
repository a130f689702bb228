from __future__ import annotations

import struct

from conftest import plan_text
from pyspark.sql import functions as F

from wireloom.functions import addresses, binary
from wireloom.operators import decode

ETH = bytes(12)


def ipv4(payload: bytes, proto: int, options: bytes = b"", frag: int = 0, total=None) -> bytes:
    ihl = 5 + len(options) // 4
    total = total if total is not None else ihl * 4 + len(payload)
    head = struct.pack(
        ">BBHHHBBH4s4s", 0x40 | ihl, 0, total, 0, frag, 64, proto, 0,
        bytes([10, 0, 0, 1]), bytes([200, 1, 2, 3]),
    )
    return ETH + b"\x08\x00" + head + options + payload


def tcp(payload=b"", flags=0x18, options=b"", seq=7, ack=9) -> bytes:
    words = 5 + len(options) // 4
    head = struct.pack(">HHIIBBHHH", 40000, 443, seq, ack, words << 4, flags, 1, 0, 0)
    return head + options + payload


def udp(payload: bytes) -> bytes:
    return struct.pack(">HHHH", 53, 5353, 8 + len(payload), 0) + payload


FRAMES = {
    "plain": ipv4(tcp(b"hello"), 6),
    "ip_options": ipv4(tcp(b"abc"), 6, options=b"\x01" * 8),
    "tcp_options": ipv4(tcp(b"xy", options=b"\x01" * 12), 6),
    "padded": (ipv4(tcp(flags=0x10), 6) + bytes(6)),
    "no_payload": ipv4(tcp(flags=2, seq=2**32 - 1, ack=0), 6),
    "first_fragment": ipv4(tcp(b"frag"), 6, frag=0x2000),
    "udp": ipv4(udp(b"q"), 17),
    "later_fragment": ipv4(tcp(b"frag"), 6, frag=0x00B9),
    "icmp": ipv4(bytes(20), 1),
    "vlan": ETH + b"\x81\x00\x00\x01" + ipv4(tcp(b"v"), 6)[12:],
    "vlans": ETH + b"\x88\xa8\x00\x02" * 3 + b"\x81\x00\x00\x01" + ipv4(tcp(b"vv"), 6)[12:] + bytes(4),
    "vlan_arp": ETH + b"\x81\x00\x00\x01" + b"\x08\x06" + bytes(40),
    "only_tags": ETH + b"\x81\x00\x00\x01" * 5,
    "ipv6": ETH + b"\x86\xdd" + b"\x60" + bytes(60),
    "arp": ETH + b"\x08\x06" + bytes(28),
    "short_tcp": ipv4(tcp(b"")[:12], 6),
    "short_options": ipv4(tcp(b"")[:12] + b"\xf0" + tcp(b"")[13:], 6),
    "short_ip": (ETH + b"\x08\x00\x45")[:15],
    "empty": b"",
}


def frames(spark):
    rows = [(name, 1000 + i, r) for i, (name, r) in enumerate(FRAMES.items())]
    return spark.createDataFrame(rows, "rowkey string, t bigint, r binary")


def test_tcp_fields(spark):
    rows = decode.packet_features(frames(spark)).collect()
    got = {r["rowkey"]: (bytes(r["payload"]), r["pld_len"], r["tcp_flags"]) for r in rows}
    assert got == {
        "plain": (b"hello", 5, 24),
        "ip_options": (b"abc", 3, 24),
        "tcp_options": (b"xy", 2, 24),
        "padded": (b"\x00", 0, 16),
        "no_payload": (b"\x00", 0, 2),
        "first_fragment": (b"frag", 4, 24),
        "vlan": (b"v", 1, 24),
        "vlans": (b"vv", 2, 24),
    }
    by_name = {r["rowkey"]: r for r in rows}
    assert (by_name["plain"]["sport"], by_name["plain"]["dport"]) == (40000, 443)
    assert by_name["no_payload"]["seq"] == 2**32 - 1
    assert by_name["padded"]["pkt_len"] == len(FRAMES["padded"])


def test_five_tuples(spark):
    rows = {r["rowkey"]: r for r in decode.five_tuple(frames(spark)).collect()}
    assert set(rows) == {
        "plain", "ip_options", "tcp_options", "padded", "no_payload", "first_fragment", "udp",
        "vlan", "vlans",
    }
    kept = decode.decode_succeeded(frames(spark)).collect()
    assert {r["rowkey"]: bytes(r["r"]) for r in kept} == {name: FRAMES[name] for name in rows}
    assert rows["udp"]["pr"] == 17 and (rows["udp"]["sp"], rows["udp"]["dp"]) == (53, 5353)
    assert rows["plain"]["si"] == 0x0A000001 and rows["plain"]["di"] == 0xC8010203


def test_one_pass_decode_agrees(spark):
    both = decode.decoded_packets(frames(spark))
    tcp_rows = both.where("pr = 6").select("rowkey", "tcp_flags", "seq", "ack", "pkt_len", "pld_len")
    other = decode.packet_features(frames(spark)).select(*tcp_rows.columns)
    assert sorted(tcp_rows.collect()) == sorted(other.collect())
    row = both.where("rowkey = 'udp'").first()
    assert row["tcp_flags"] is None and row["pld_len"] is None and row["payload"] is None


def test_decode_has_no_python(spark):
    for df in (decode.five_tuple(frames(spark)), decode.packet_features(frames(spark))):
        assert "Python" not in plan_text(df) and "ArrowEval" not in plan_text(df)


def test_mark_is_the_same_both_ways_and_signed(spark):
    rows = [(1, 0x0A000001, 1000, 0xAC100001, 80, 6), (2, 0xAC100001, 80, 0x0A000001, 1000, 6)]
    df = addresses.with_flow_key(
        spark.createDataFrame(rows, "rowkey int, si bigint, sp int, di bigint, dp int, pr int")
    )
    marks = df.select(addresses.flow_mark(F.col("lo"), F.col("hi"), F.col("pr")).alias("fm"))
    first, second = (bytes(r["fm"]) for r in marks.collect())
    # 172.16.0.1 has the top bit set, so as a signed number it comes first.
    assert first == second == bytes.fromhex("ac1000010050" "0a00000103e8" "06")


def test_byte_functions(spark):
    df = spark.createDataFrame([(bytes([0x0A, 0, 255, 0x41]),), (b"",)], "b binary")
    got = df.select(
        binary.hex_spaced(F.col("b")).alias("spaced"),
        binary.printable(F.col("b")).alias("shown"),
        binary.hex_lower(F.col("b")).alias("h"),
    ).collect()
    assert tuple(got[0]) == ("a 0 ff 41", "\\x0a\\x00\\xffA", "0a00ff41")
    assert tuple(got[1]) == ("", "", "")
    n = spark.range(1).select(
        binary.unsigned(F.lit(b"\xff\xff")).alias("u"),
        binary.signed(F.lit(b"\xff\xff"), 2).alias("s"),
        binary.hex_lower(binary.fixed_width(F.lit(-2), 6)).alias("f"),
        binary.timestamp_us(F.lit(3), F.lit(7)).alias("t"),
    )
    assert tuple(n.first()) == (65535, -1, "fffffffffffe", 3000007)


def test_tag_runs_are_looked_for_once(spark):
    from conftest import plan_text

    df = spark.range(3).selectExpr("id rowkey", "id t", "unhex(hex(id)) r")
    for frames in (decode.five_tuple(df), decode.packet_features(df), decode.decoded_packets(df)):
        assert plan_text(frames).count("8100|88A8") == 1
