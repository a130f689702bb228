"""Generated methods stay small: HotSpot never compiles one of more than 8,000 bytes."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import DataFrame

import checks.fixtures as fx
from wireloom.functions.addresses import with_flow_key
from wireloom.operators import decode, features, tcp

LARGEST = 8_000


@pytest.fixture
def whole_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def method_bytes(df: DataFrame) -> list[int]:
    """The largest method of each generated stage of a plan."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    text = df._jdf.queryExecution().explainString(mode)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]


@pytest.mark.parametrize(
    "query", [features.session_features, features.session_features_wide, features.direction_statistics]
)
def test_session_statistics_are_compiled(spark, sf, whole_plans, query):
    found = method_bytes(query(tcp.tag_sessions(fx.packet_table(spark, sf))))
    assert found and max(found) <= LARGEST


def test_decoder_is_compiled(spark, sf, whole_plans):
    packets = with_flow_key(decode.decoded_packets(fx.frame_table(spark, sf))).drop("r")
    found = method_bytes(packets)
    assert found and max(found) <= LARGEST


def test_packets_are_stored_in_larger_files(spark, sf):
    rows = spark.range(60_000).coalesce(1)
    small = fx.stored(spark, sf, "probe of small files", lambda: rows)
    large = fx.stored(spark, sf, "probe of packet files", lambda: rows, fx.PACKETS_PER_FILE)
    assert (len(small.inputFiles()), len(large.inputFiles())) == (3, 1)
    assert large.count() == 60_000
