"""Summary reports over packet, session and cluster tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.functions.addresses import FLOW, endpoint_label, flow_label
from wireloom.functions.binary import hex_lower
from wireloom.operators.tcp import ACK, SYN, SYN_ACK


def _per_session(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    return tagged.groupBy(*keys, "sid_ts").agg(F.count(F.lit(1)).alias("packets"))


def session_report(packets: DataFrame, tagged: DataFrame) -> DataFrame:
    """One row: packets, 5-tuples, sessions, sessions per 5-tuple, packets per session.

    Counts climb level by level (packets, sessions, 5-tuples, total), so no distinct count is needed.
    """
    flows = packets.groupBy(*FLOW).agg(F.count(F.lit(1)).alias("n"))
    seen = flows.agg(F.sum("n").alias("packets"), F.count(F.lit(1)).alias("flows"))
    per_flow = (
        _per_session(tagged, FLOW)
        .groupBy(*FLOW)
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.sum("packets").alias("tagged"),
            F.min("packets").alias("shortest"),
            F.max("packets").alias("longest"),
        )
    )
    kept = per_flow.agg(
        F.sum("sessions").alias("sessions"),
        F.sum("tagged").alias("tagged_packets"),
        F.avg("sessions").alias("sessions_per_flow"),
        F.max("sessions").alias("max_sessions_per_flow"),
        F.min("shortest").alias("min_packets_per_session"),
        F.max("longest").alias("max_packets_per_session"),
    )
    whole = kept.select(F.struct("*").alias("kept")).scalar()
    return seen.withColumn("kept", whole).select("packets", "flows", "kept.*")


def extreme_sessions(tagged: DataFrame) -> DataFrame:
    """The longest and the shortest session by packets; equal counts by 5-tuple and time."""
    sessions = _per_session(tagged, FLOW)
    ties = [*FLOW, "sid_ts"]
    longest = sessions.orderBy(F.desc("packets"), *ties).limit(1)
    shortest = sessions.orderBy("packets", *ties).limit(1)
    label = flow_label(F.col("lo"), F.col("hi"), F.col("sid_ts")).alias("session")
    return longest.select(F.lit("longest").alias("kind"), label, "packets").unionByName(
        shortest.select(F.lit("shortest").alias("kind"), label, "packets")
    )


def udp_report(tagged: DataFrame, keys: Sequence[str] = FLOW) -> DataFrame:
    """One row: packets, 5-tuples, sessions, tagged packets."""
    per_flow = (
        _per_session(tagged, keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("sessions"), F.sum("packets").alias("packets"))
    )
    return per_flow.agg(
        F.sum("packets").alias("packets"),
        F.count(F.lit(1)).alias("flows"),
        F.sum("sessions").alias("sessions"),
        F.sum("packets").alias("tagged_packets"),
    ).na.fill(0)


def sessions_per_endpoint(sessions: DataFrame) -> DataFrame:
    """Sessions of each server endpoint with its label, largest first."""
    return (
        sessions.groupBy("server", "pr")
        .agg(F.count(F.lit(1)).alias("sessions"))
        .select(endpoint_label(F.col("server"), F.col("pr")).alias("endpoint"), "sessions")
        .orderBy(F.desc("sessions"), "endpoint")
    )


def distinct_endpoints(sessions: DataFrame) -> DataFrame:
    return sessions.select(hex_lower(F.col("m")).alias("m")).distinct()


def endpoint_digest(sessions: DataFrame) -> DataFrame:
    """Port and digest of each endpoint."""
    return sessions.select(
        F.col("dport").alias("port"), F.md5(F.col("m")).alias("digest")
    ).distinct()


def packet_counters(packets: DataFrame) -> DataFrame:
    """One row of packet counts by handshake step."""
    flags = F.col("tcp_flags")
    return packets.agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(flags == SYN).alias("syn"),
        F.count_if(flags == SYN_ACK).alias("syn_ack"),
        F.count_if(flags == ACK).alias("ack"),
    )


def job_counters(packets: DataFrame, tagged: DataFrame, starts: DataFrame) -> DataFrame:
    """The counts a job prints: packets by step, handshakes, packets tagged with a session."""
    count = F.count(F.lit(1))
    return packet_counters(packets).withColumns(
        {
            "handshakes": starts.agg(count.alias("n")).scalar(),
            "tagged_packets": tagged.agg(count.alias("n")).scalar(),
        }
    )
