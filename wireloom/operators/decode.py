"""Header decode of Ethernet / IPv4 / TCP / UDP frames as column expressions.

Nothing leaves the JVM: every field is a substring of the frame at an offset computed from the
header-length fields.  Any run of 802.1Q and 802.1ad tags in front of the IPv4 layer is skipped.  A frame
that is too short for its headers, options included, or is not IPv4 TCP/UDP, is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.binary import slice_uint

# Fixed values of the header layouts.
ETHERNET_HEADER = 14
ETHERTYPE_IPV4 = b"\x08\x00"
ETHERTYPE_TAGS = (b"\x81\x00", b"\x88\xa8")
TAG_RUN = "^(?:(?:8100|88A8)[0-9A-F]{4})+"
IPV4_SHORTEST, IPV4_LONGEST = b"\x45", b"\x4f"
PROTO_TCP = 6
PROTO_UDP = 17
TCP_HEADER_MIN = 20
UDP_HEADER = 8
# Flags and fragment offset of a packet that is whole or the first fragment: later fragments carry no
# transport header.
FIRST_FRAGMENT = [bytes([flags << 5, 0]) for flags in range(8)]


def _tag_bytes(r: Column) -> Column:
    """Bytes of tags between the addresses and the type of the payload; most frames have none."""
    tagged = F.substring(r, 13, 2).isin([F.lit(t) for t in ETHERTYPE_TAGS])
    run = F.regexp_extract(F.hex(F.substring(r, 13, 1 << 30)), TAG_RUN, 0)
    return F.when(tagged, F.length(run) / 2).otherwise(0).cast("int")


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that stays a value of its own: later filters and projections do not repeat its expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _with_layers(frames: DataFrame, tcp_only: bool = False) -> DataFrame:
    """Keep IPv4 frames that carry a whole TCP or UDP header; add ``pr``, ``l3``, ``l4`` and ``ip``.

    The filter compares raw bytes, so a frame is turned down before any field is converted.  ``ip`` is the first word
    of the IP header; neighbouring fields are converted together, which also keeps the decoder in a method
    small enough for the JVM to compile it (8,000 bytes).
    """
    r, l3 = F.col("r"), F.col("l3")
    proto = F.substring(r, l3 + 10, F.lit(1))
    is_tcp = proto == F.lit(bytes([PROTO_TCP]))
    is_udp = proto == F.lit(bytes([PROTO_UDP]))
    outer_type = F.substring(r, 13, 2)
    types = (ETHERTYPE_IPV4, *ETHERTYPE_TAGS)
    first = _held(
        frames.where(outer_type.isin([F.lit(t) for t in types])), "l3", _tag_bytes(r) + ETHERNET_HEADER
    ).where(
        (F.substring(r, l3 - 1, F.lit(2)) == F.lit(ETHERTYPE_IPV4))
        & F.substring(r, l3 + 1, F.lit(1)).between(F.lit(IPV4_SHORTEST), F.lit(IPV4_LONGEST))
        & F.substring(r, l3 + 7, F.lit(2)).isin([F.lit(f) for f in FIRST_FRAGMENT])
        & (is_tcp if tcp_only else is_tcp | is_udp)
    )
    pr = F.when(is_tcp, PROTO_TCP).otherwise(PROTO_UDP)
    l4 = (F.shiftright("ip", 24).bitwiseAND(F.lit(15)) * 4 + l3).cast("int")
    header = F.when(F.col("pr") == PROTO_TCP, F.lit(TCP_HEADER_MIN)).otherwise(F.lit(UDP_HEADER))
    return (
        _held(_held(first, "pr", pr), "ip", slice_uint(r, l3, 4))
        .withColumn("l4", l4)
        .where(F.length(r) >= F.col("l4") + header)
    )


def _with_payload_bounds(layers: DataFrame) -> DataFrame:
    """Drop TCP frames that end inside the TCP header; add ``start``, ``pld_len`` and ``tcp``, null for UDP.

    The payload ends where the IP total length says, so Ethernet padding is not payload.  ``tcp`` holds the header's
    length and the flags byte, ``ports`` both ports.
    """
    r, l4 = F.col("r"), F.col("l4")
    tcp = F.col("pr") == PROTO_TCP
    end = F.least(F.col("ip").bitwiseAND(F.lit(65535)) + F.col("l3"), F.length(r).cast("bigint"))
    length = F.when(tcp, F.greatest(end - F.col("start"), F.lit(0)).cast("int"))
    return (
        _held(layers, "tcp", F.when(tcp, slice_uint(r, l4 + 12, 2)))
        .withColumn("start", (l4 + F.shiftright("tcp", 12) * 4).cast("int"))
        .where(~tcp | ((F.col("start") >= l4 + TCP_HEADER_MIN) & (F.length(r) >= F.col("start"))))
        .withColumn("pld_len", length)
        .transform(_held, "ports", slice_uint(r, l4, 4))
    )


def _tcp_flags() -> Column:
    return F.col("tcp").bitwiseAND(F.lit(255)).cast("int")


def _source_port() -> Column:
    return F.shiftright("ports", 16)


def _target_port() -> Column:
    return F.col("ports").bitwiseAND(F.lit(65535))


def _payload() -> Column:
    cut = F.substring("r", F.col("start") + 1, F.col("pld_len"))
    return F.when(F.col("pld_len") > 0, cut).otherwise(F.lit(b"\x00"))


def five_tuple(frames: DataFrame) -> DataFrame:
    """``(rowkey, t, r)`` to the same plus ``si, sp, di, dp, pr``; TCP and UDP over IPv4 only."""
    r = F.col("r")
    return _with_payload_bounds(_with_layers(frames)).select(
        "rowkey",
        "t",
        "r",
        slice_uint(r, F.col("l3") + 12, 4).alias("si"),
        _source_port().alias("sp"),
        slice_uint(r, F.col("l3") + 16, 4).alias("di"),
        _target_port().alias("dp"),
        "pr",
    )


def decode_succeeded(frames: DataFrame) -> DataFrame:
    """The raw packets that decode."""
    return _with_payload_bounds(_with_layers(frames)).select(*frames.columns)


def packet_features(frames: DataFrame) -> DataFrame:
    """TCP fields of each frame; a packet without payload has length 0 and one zero byte."""
    r = F.col("r")
    return _with_payload_bounds(_with_layers(frames, tcp_only=True)).select(
        "rowkey",
        _target_port().alias("dport"),
        _source_port().alias("sport"),
        F.col("pr").alias("proto"),
        _tcp_flags().alias("tcp_flags"),
        slice_uint(r, F.col("l4") + 4, 4).alias("seq"),
        slice_uint(r, F.col("l4") + 8, 4).alias("ack"),
        F.length(r).alias("pkt_len"),
        "pld_len",
        _payload().alias("payload"),
    )


def decoded_packets(frames: DataFrame) -> DataFrame:
    """Five-tuple and TCP fields of each frame in one pass; UDP rows have null TCP fields."""
    r = F.col("r")
    tcp = F.col("pr") == PROTO_TCP
    return _with_payload_bounds(_with_layers(frames)).select(
        "rowkey",
        "t",
        "r",
        slice_uint(r, F.col("l3") + 12, 4).alias("si"),
        _source_port().alias("sp"),
        slice_uint(r, F.col("l3") + 16, 4).alias("di"),
        _target_port().alias("dp"),
        "pr",
        _tcp_flags().alias("tcp_flags"),
        F.when(tcp, slice_uint(r, F.col("l4") + 4, 4)).alias("seq"),
        F.when(tcp, slice_uint(r, F.col("l4") + 8, 4)).alias("ack"),
        F.length(r).alias("pkt_len"),
        "pld_len",
        F.when(tcp, _payload()).alias("payload"),
    )


def packet_direction(packets: DataFrame) -> DataFrame:
    """``direction``: ((source), (destination), protocol) of a TCP packet, null for others."""
    ends = F.struct(
        F.struct(F.col("si").alias("ip"), F.col("sp").alias("port")).alias("src"),
        F.struct(F.col("di").alias("ip"), F.col("dp").alias("port")).alias("dst"),
        F.col("pr").alias("proto"),
    )
    return packets.withColumn("direction", F.when(F.col("pr") == PROTO_TCP, ends))


def tcp_payload(packets: DataFrame) -> DataFrame:
    """``tcp_payload``: the payload of a TCP packet that has one, null otherwise."""
    present = (F.col("pr") == PROTO_TCP) & (F.col("pld_len") > 0)
    return packets.withColumn("tcp_payload", F.when(present, F.col("payload")))
