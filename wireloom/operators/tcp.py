"""TCP sessions: handshakes and the tagging of packets with the handshake they follow.

Two methods.  Method 1 accepts any SYN that a later SYN-ACK and ACK complete and never ends a
session.  Method 2 follows the latest SYN and ends a session at FIN or RST.

Input packets: ``rowkey, t, lo, hi, pr, src_lo, tcp_flags, seq, ack`` (see ``with_flow_key``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from wireloom.functions.addresses import FLOW
from wireloom.operators.decode import PROTO_TCP
from wireloom.plans.skew import CHUNK, ROWS_PER_CHUNK, Splits, find_splits, running
from wireloom.plans.staging import stage

# Fixed values of the flags byte.
SYN, SYN_ACK, ACK = 0x02, 0x12, 0x10
FIN_OR_RST = 0x05

#: One handshake: the 5-tuple, which end is the client, and the client's initial sequence number.
HANDSHAKE = (*FLOW, "client_lo", "isn")


def handshake_candidates(packets: DataFrame) -> DataFrame:
    """Packets whose flags byte is exactly SYN, SYN-ACK or ACK."""
    return packets.where(F.col("tcp_flags").isin(SYN, SYN_ACK, ACK))


def is_stop() -> Column:
    return F.col("tcp_flags").bitwiseAND(F.lit(FIN_OR_RST)) != 0


def stop_packets(packets: DataFrame) -> DataFrame:
    """Packets with the FIN or RST bit."""
    return packets.where(is_stop())


def _handshake_rows(packets: DataFrame) -> DataFrame:
    """Handshake packets on a common key: all three steps agree on client and initial number.

    ``sisn`` is the server's initial number, known to the SYN-ACK and the ACK.
    """
    flags = F.col("tcp_flags")
    from_client = flags != SYN_ACK
    isn = (
        F.when(flags == SYN, F.col("seq"))
        .when(flags == SYN_ACK, F.col("ack") - 1)
        .otherwise(F.col("seq") - 1)
    )
    sisn = F.when(flags == SYN_ACK, F.col("seq")).when(flags == ACK, F.col("ack") - 1)
    keep = [c for c in (*FLOW, CHUNK, "t", "rowkey", "tcp_flags", "ack") if c in packets.columns]
    return handshake_candidates(packets).select(
        *keep,
        F.when(from_client, F.col("src_lo"))
        .otherwise(~F.col("src_lo") | (F.col("lo") == F.col("hi")))
        .alias("client_lo"),
        isn.alias("isn"),
        sisn.alias("sisn"),
    )


def handshakes_any(packets: DataFrame) -> DataFrame:
    """Method 1: every SYN completed by some later SYN-ACK and some ACK after that.

    Only the existence of the later steps matters, so each step is reduced to its latest time
    before it is joined: no step multiplies another.
    """
    rows = _handshake_rows(packets)
    flags = F.col("tcp_flags")
    acks = (
        rows.where(flags == ACK).groupBy(*HANDSHAKE, "sisn").agg(F.max("t").alias("latest_ack"))
    )
    syn_acks = (
        rows.where(flags == SYN_ACK)
        .join(acks, [*HANDSHAKE, "sisn"])
        .where(F.col("t") <= F.col("latest_ack"))
        .groupBy(*HANDSHAKE)
        .agg(F.max("t").alias("latest_syn_ack"))
    )
    return (
        rows.where(flags == SYN)
        .join(syn_acks, list(HANDSHAKE))
        .where(F.col("t") <= F.col("latest_syn_ack"))
        .select(*FLOW, F.col("t").alias("start_ts"))
        .distinct()
    )


def handshakes_latest(packets: DataFrame) -> DataFrame:
    """Method 2: distinct ``(5-tuple, start_ts)`` of completed handshakes.

    A SYN-ACK takes the latest SYN before it, an ACK the latest such SYN-ACK.  Both steps share the
    handshake key, so the rows shuffle once for two window passes.
    """
    flags = F.col("tcp_flags")
    rows = _handshake_rows(packets).where((flags != SYN) | (F.col("ack") == 0))
    order = ("t", "rowkey")
    answered = running(
        rows, HANDSHAKE, order, {"syn_ts": ("max", F.when(flags == SYN, F.col("t")))}
    )
    if CHUNK in rows.columns:
        # The second pass reads the first one twice when keys are cut into chunks.
        answered = stage(answered, "answered")
    # Within one handshake key the SYN time only grows, so "latest SYN-ACK's SYN" is a running max.
    completed = running(
        answered.where(flags != SYN),
        (*HANDSHAKE, "sisn"),
        order,
        {"start_ts": ("max", F.when(flags == SYN_ACK, F.col("syn_ts")))},
    )
    return (
        completed.where((flags == ACK) & F.col("start_ts").isNotNull())
        .select(*FLOW, "start_ts")
        .distinct()
    )


def _with_starts(packets: DataFrame, starts: DataFrame, splits: Splits) -> DataFrame:
    """Packets and start markers in one table, so that one shuffle orders both."""
    if splits.cuts is not None:
        starts = stage(starts, "starts")
    markers = splits.assign(starts.withColumn("t", F.col("start_ts")))
    return packets.unionByName(markers, allowMissingColumns=True)


def tag_any(packets: DataFrame, rows_per_chunk: int | None = ROWS_PER_CHUNK) -> DataFrame:
    """Method 1: tag every packet with the latest handshake at or before it (``sid_ts``)."""
    packets = packets.drop(CHUNK)
    splits = find_splits(packets, FLOW, rows_per_chunk=rows_per_chunk)
    packets = splits.assign(packets)
    both = _with_starts(packets, handshakes_any(packets), splits)
    return (
        running(both, FLOW, ("t",), {"sid_ts": ("max", F.col("start_ts"))})
        .where(F.col("rowkey").isNotNull() & F.col("sid_ts").isNotNull())
        .drop("start_ts")
    )


def tag_sessions(
    packets: DataFrame,
    rows_per_chunk: int | None = ROWS_PER_CHUNK,
    outside: bool = False,
    seen: Observation | None = None,
) -> DataFrame:
    """Method 2: keep packets inside a session and add its start time as ``sid_ts``.

    ``outside`` keeps the other packets too, with a null ``sid_ts``.  ``seen`` gets the number of handshakes.

    A packet is inside when the last marker at or before it is a start; a FIN/RST packet is itself a
    stop, and a stop beats a start at the same time.
    """
    packets = packets.where(F.col("pr") == PROTO_TCP).drop(CHUNK)
    splits = find_splits(packets, FLOW, rows_per_chunk=rows_per_chunk)
    packets = splits.assign(packets)
    starts = handshakes_latest(packets)
    if seen is not None:
        starts = starts.observe(seen, F.count(F.lit(1)).alias("handshakes"))
    both = _with_starts(packets, starts, splits)
    marked = running(
        both,
        FLOW,
        ("t",),
        {
            "sid_ts": ("max", F.col("start_ts")),
            "last_stop": ("max", F.when(is_stop(), F.col("t"))),
        },
    )
    inside = F.col("last_stop").isNull() | (F.col("sid_ts") > F.col("last_stop"))
    tagged = (
        marked.where(F.col("rowkey").isNotNull())
        .withColumn("sid_ts", F.when(inside, F.col("sid_ts")))
        .drop("start_ts", "last_stop")
    )
    return tagged if outside else tagged.where(F.col("sid_ts").isNotNull())


def session_markers(packets: DataFrame) -> DataFrame:
    """Starts (``kind`` 0) and stops (1) of sessions with their times, in one table."""
    starts = handshakes_latest(packets).select(
        *FLOW, F.lit(0).alias("kind"), F.col("start_ts").alias("t")
    )
    return starts.unionByName(stop_packets(packets).select(*FLOW, F.lit(1).alias("kind"), "t"))


def distinct_sessions(tagged: DataFrame) -> DataFrame:
    return tagged.select(*FLOW, "sid_ts").distinct()
