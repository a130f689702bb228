"""Byte-string helpers built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unsigned(b: Column) -> Column:
    """Big-endian bytes (up to 8) as an unsigned integer."""
    return F.conv(F.hex(b), 16, 10).cast("bigint")


def signed(b: Column, width: int) -> Column:
    """Big-endian bytes of a fixed ``width`` (below 8) as a two's complement integer."""
    n = unsigned(b)
    return F.when(n >= 1 << (8 * width - 1), n - (1 << (8 * width))).otherwise(n)


def fixed_hex(n: Column, width: int) -> Column:
    """Integer as the hex text of exactly ``width`` bytes; negatives in two's complement."""
    bits = n.cast("bigint")
    if width < 8:
        bits = bits.bitwiseAND(F.lit((1 << (8 * width)) - 1))
    return F.lpad(F.hex(bits), 2 * width, "0")


def fixed_width(n: Column, width: int) -> Column:
    """Integer as exactly ``width`` big-endian bytes; negatives in two's complement."""
    return F.unhex(fixed_hex(n, width))


def slice_uint(b: Column, offset: Column | int, width: int) -> Column:
    """Unsigned integer of ``width`` bytes at a 0-based offset."""
    start = offset + 1 if isinstance(offset, int) else offset + F.lit(1)
    return unsigned(F.substring(b, start, width))


def md5_bytes(b: Column) -> Column:
    return F.unhex(F.md5(b))


def from_hex(s: Column | str) -> Column:
    return F.unhex(F.lit(s) if isinstance(s, str) else s)


def hex_lower(b: Column) -> Column:
    return F.lower(F.hex(b))


def hex_spaced(b: Column) -> Column:
    """Bytes as space-separated hex without zero padding, e.g. ``a 0 ff``."""
    pairs = F.regexp_replace(hex_lower(b), "(..)", "$1 ")
    return F.trim(F.regexp_replace(pairs, "(^| )0(?=[0-9a-f])", "$1"))


def printable(b: Column) -> Column:
    r"""ASCII 32..126 kept, every other byte written as ``\xNN``."""
    pairs = F.regexp_extract_all(hex_lower(b), F.lit(".."), F.lit(0))

    def show(pair: Column) -> Column:
        code = F.conv(pair, 16, 10).cast("int")
        return F.when(pair.between("20", "7e"), F.chr(code)).otherwise(
            F.concat(F.lit("\\x"), pair)
        )

    return F.array_join(F.transform(pairs, show), "")


def timestamp_us(sec: Column, usec: Column) -> Column:
    return sec.cast("bigint") * 1000000 + usec.cast("bigint")
