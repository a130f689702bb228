"""Sliding slices of a payload, carried as upper-case hex so any byte is representable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _slices(payload: Column, width: int, count: Column) -> Column:
    # sequence() counts down when its end lies below its start, hence the two guards.
    starts = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    cut = F.transform(starts, lambda i: F.hex(F.substring(payload, i, F.lit(width))))
    return F.when(count >= 1, cut).otherwise(F.array().cast("array<string>"))


def trigrams(payload: Column) -> Column:
    """Three-byte slices at positions 0 .. L-4; the slice ending on the last byte is left out."""
    return _slices(payload, 3, F.length(payload) - 3)


def trigram_positions(payload: Column) -> Column:
    """1-based starts of ``trigrams``, for payloads longer than three bytes."""
    return F.sequence(F.lit(1), F.length(payload) - 3)


def byte_slices(payload: Column, width: int) -> Column:
    """All ``width``-byte slices, the last one included."""
    return _slices(payload, width, F.length(payload) - (width - 1))


def item_base64(item: Column) -> Column:
    return F.base64(F.unhex(item))
