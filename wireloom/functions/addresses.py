"""IPv4 endpoints: 48-bit keys, canonical 5-tuple marks and labels.

An endpoint is ``ip * 65536 + port`` read as a signed 48-bit integer.  The two endpoints of a
packet, smaller first, together with the protocol name the direction-free 5-tuple.  Operators
group on these integers; the byte forms are projected when a table is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.functions.binary import fixed_hex, md5_bytes

#: Columns that identify a direction-free 5-tuple.
FLOW = ("lo", "hi", "pr")


def endpoint_key(ip: Column, port: Column) -> Column:
    k = ip.cast("bigint") * 65536 + port.cast("bigint")
    return F.when(k >= 1 << 47, k - (1 << 48)).otherwise(k)


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Add ``lo``, ``hi`` (the endpoints in signed order) and ``src_lo`` (source is ``lo``)."""
    src = endpoint_key(F.col("si"), F.col("sp"))
    dst = endpoint_key(F.col("di"), F.col("dp"))
    return packets.withColumns(
        {"lo": F.least(src, dst), "hi": F.greatest(src, dst), "src_lo": src <= dst}
    )


def _flow_hex(lo: Column, hi: Column, pr: Column) -> Column:
    return F.concat(fixed_hex(lo, 6), fixed_hex(hi, 6), fixed_hex(pr, 1))


def flow_mark(lo: Column, hi: Column, pr: Column) -> Column:
    """13-byte mark of a 5-tuple: both endpoints and the protocol."""
    return F.unhex(_flow_hex(lo, hi, pr))


def session_id(lo: Column, hi: Column, pr: Column, sid_ts: Column) -> Column:
    """21-byte session id: the 5-tuple mark and the session's time."""
    return F.unhex(F.concat(_flow_hex(lo, hi, pr), fixed_hex(sid_ts, 8)))


def session_rowkey(lo: Column, hi: Column, pr: Column, sid_ts: Column) -> Column:
    return md5_bytes(session_id(lo, hi, pr, sid_ts))


def endpoint_mark(endpoint: Column, pr: Column) -> Column:
    """7-byte mark of a server endpoint: address, port, protocol."""
    return F.unhex(F.concat(fixed_hex(endpoint, 6), fixed_hex(pr, 1)))


def endpoint_bits(endpoint: Column) -> Column:
    """The endpoint key as the unsigned 48-bit number again."""
    return F.when(endpoint < 0, endpoint + (1 << 48)).otherwise(endpoint)


def dotted(ip: Column) -> Column:
    ip = ip.cast("bigint")
    parts = [F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def endpoint_label(endpoint: Column, pr: Column) -> Column:
    """``a.b.c.d:port-proto``."""
    bits = endpoint_bits(endpoint)
    return F.concat(
        dotted(F.shiftright(bits, 16)),
        F.lit(":"),
        bits.bitwiseAND(F.lit(65535)).cast("string"),
        F.lit("-"),
        pr.cast("string"),
    )


def flow_label(lo: Column, hi: Column, ts: Column) -> Column:
    """``hi-endpoint - lo-endpoint _ time`` as printed in the session report."""

    def show(endpoint: Column) -> Column:
        bits = endpoint_bits(endpoint)
        port = bits.bitwiseAND(F.lit(65535)).cast("string")
        return F.concat(dotted(F.shiftright(bits, 16)), F.lit(":"), port)

    return F.concat(show(hi), F.lit("-"), show(lo), F.lit("_"), ts.cast("string"))
