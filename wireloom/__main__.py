"""Command line of the batch jobs: ``python -m wireloom JOB ...`` or ``spark-submit``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.operators import clusters, keywords, reports, tcp, udp
from wireloom.plans import jobs
from wireloom.sources import capture, tables
from wireloom.sources.keyed import PREFIX, KeyedTable
from wireloom.streaming import ingest


def _put(df: DataFrame, path: str, a: argparse.Namespace, key: str = "rowkey") -> None:
    """Replace the table at ``path``, or put rows into the keyed table there."""
    if a.update:
        KeyedTable(path, df.schema, key, a.prefixes).create(df.sparkSession).upsert(df)
    else:
        tables.write(df, path)


def _ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write(capture.read_captures(spark, a.captures, a.range_bytes), a.out, mode="append")


def _stream(spark: SparkSession, a: argparse.Namespace) -> None:
    raw = ingest.raw_packets(ingest.kafka_stream(spark, a.servers, a.topic))
    if a.update:
        table = KeyedTable(a.out, tables.RAW_PACKETS, prefixes=a.prefixes).create(spark)
        ingest.upsert_stream(raw, table, a.checkpoint).awaitTermination()
    else:
        ingest.write_stream(raw, a.out, a.checkpoint).awaitTermination()


def _preprocess(spark: SparkSession, a: argparse.Namespace) -> None:
    done = jobs.preprocess(tables.scan(spark, a.raw, ["rowkey", "t", "r"]), a.gap_us)
    print(" ".join(f"{name}={n}" for name, n in done.counters.items()))
    _put(done.packets, a.packets, a)
    _put(done.sessions, a.sessions, a)


def _sessions(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return tables.scan(spark, f"{a.sessions}/rows").drop(PREFIX) if a.update else tables.scan(spark, a.sessions)


def _train(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.update:
        old = KeyedTable(a.models, tables.MODELS, "id", a.prefixes).create(spark).read(spark)
    elif a.old == "none":
        old = spark.createDataFrame([], tables.MODELS)
    else:
        old = tables.scan(spark, a.old, schema=tables.MODELS)
    trained = jobs.train(_sessions(spark, a), old, a.endpoint)
    _put(trained.profiles, a.profiles, a)
    _put(trained.models, a.models, a, "id")


def _identify(spark: SparkSession, a: argparse.Namespace) -> None:
    models = tables.scan(spark, a.models, schema=tables.MODELS)
    found = jobs.identify(tables.scan(spark, a.sessions), models, a.session)
    tables.write(found, a.out)


def _cluster(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write(clusters.cluster_profiles(tables.scan(spark, a.profiles)), a.out)


def _keywords(spark: SparkSession, a: argparse.Namespace) -> None:
    payloads = tables.scan(spark, a.packets, ["m", "sid", "direction", "payload"])
    words = jobs.mine_keywords(payloads, a.fraction, a.seed)
    tables.write(words, a.out)


def _report(spark: SparkSession, a: argparse.Namespace) -> None:
    reports.sessions_per_endpoint(tables.scan(spark, a.sessions)).show(a.rows, truncate=False)


def _latest_sessions(spark: SparkSession, a: argparse.Namespace) -> None:
    packets = tables.scan(spark, a.packets).where(F.col("pr") == tcp.PROTO_TCP)
    kept = packets.drop("sid_ts", "sid", "direction", "m", "payload")
    tables.write(tcp.tag_any(kept), a.out)


def _tcp_report(spark: SparkSession, a: argparse.Namespace) -> None:
    packets = tables.scan(spark, a.packets).where(F.col("pr") == tcp.PROTO_TCP)
    tables.write(reports.session_report(packets, tables.present(packets, "sid_ts")), a.out)


def _udp_report(spark: SparkSession, a: argparse.Namespace) -> None:
    tables.write(reports.udp_report(udp.udp_only(tables.scan(spark, a.packets))), a.out)


def _counters(spark: SparkSession, a: argparse.Namespace) -> None:
    packets = tables.scan(spark, a.packets).where(F.col("pr") == tcp.PROTO_TCP)
    tagged = tables.present(packets, "sid_ts")
    starts = tcp.handshakes_latest(packets.drop("sid_ts"))
    tables.write(reports.job_counters(packets, tagged, starts), a.out)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="wireloom", description=__doc__)
    jobs_ = parser.add_subparsers(required=True)

    def job(name: str, run, *places: str) -> argparse.ArgumentParser:
        sub = jobs_.add_parser(name)
        for place in places:
            sub.add_argument(place)
        sub.set_defaults(run=run)
        return sub

    job("ingest", _ingest, "captures", "out").add_argument(
        "--range-bytes", type=int, default=capture.RANGE_BYTES
    )
    stream = job("stream", _stream, "servers", "topic", "out", "checkpoint")
    preprocess = job("preprocess", _preprocess, "raw", "packets", "sessions")
    preprocess.add_argument("--gap-us", type=int, default=udp.GAP_US)
    train = job("train", _train, "sessions", "profiles", "models")
    train.add_argument("--old", default="none", help="existing models, or 'none'")
    train.add_argument("--endpoint", help="train one endpoint, given in hex")
    for sub in (stream, preprocess, train):
        sub.add_argument("--update", action="store_true", help="put rows into keyed tables instead of replacing tables")
        sub.add_argument("--prefixes", type=int, default=256, help="folders of a keyed table; the same for every run")
    job("identify", _identify, "sessions", "models", "out").add_argument(
        "--session", help="one session's row key in hex"
    )
    job("cluster", _cluster, "profiles", "out")
    words = job("keywords", _keywords, "packets", "out")
    words.add_argument("--fraction", type=float, default=keywords.SAMPLE_FRACTION)
    words.add_argument("--seed", type=int, default=42)
    job("report", _report, "sessions").add_argument("--rows", type=int, default=20)
    job("latest-sessions", _latest_sessions, "packets", "out")
    job("tcp-report", _tcp_report, "packets", "out")
    job("udp-report", _udp_report, "packets", "out")
    job("counters", _counters, "packets", "out")
    return parser


def main(argv: Sequence[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("wireloom").getOrCreate()
    args.run(spark, args)


if __name__ == "__main__":
    main()
