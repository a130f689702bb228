"""Orientation of packets inside their session, from the session's first packet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.functions.addresses import FLOW
from wireloom.plans.skew import running

#: A session: the 5-tuple and the session's time.
SESSION = (*FLOW, "sid_ts")


def with_first_side(tagged: DataFrame) -> DataFrame:
    """Add ``first_lo``: whether the session's first packet was sent by the ``lo`` endpoint."""
    sender = F.struct("t", "rowkey", "src_lo")
    first = running(tagged, SESSION, ("t", "rowkey"), {"first": ("min", sender)})
    return first.withColumn("first_lo", F.col("first.src_lo")).drop("first")


def packet_directions(tagged: DataFrame) -> DataFrame:
    """Add ``direction`` (forward / back) and ``server``, the first packet's destination."""
    oriented = with_first_side(tagged)
    same = F.col("src_lo") == F.col("first_lo")
    return oriented.withColumns(
        {
            "direction": F.when(same, F.lit("forward")).otherwise(F.lit("back")),
            "server": F.when(F.col("first_lo"), F.col("hi")).otherwise(F.col("lo")),
        }
    ).drop("first_lo")


def client_side(tagged: DataFrame) -> DataFrame:
    """Add ``client_sent``: the packet goes the way of the session's first packet."""
    oriented = with_first_side(tagged)
    return oriented.withColumn("client_sent", F.col("src_lo") == F.col("first_lo")).drop("first_lo")
