"""The functions of SQL text equal those of columns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wireloom.functions import addresses, binary, ratios, sql


@pytest.fixture(scope="module")
def values(spark):
    sql.register(sql.register(spark))
    rows = [
        (3232235777, 443, -(1 << 47), (1 << 47) - 1, 6, 1.0, 2.0), (0, 0, 0, -1, 17, None, 2.0),
        (4294967295, 65535, -5, 5, 255, 0.0, 0.0), (2886729728, 80, 1 << 40, 7, 1, 3.0, 0.0), (1, 2, None, 3, 6, -1.0, -4.0),
    ]
    df = spark.createDataFrame(rows, "ip bigint, port bigint, lo bigint, hi bigint, pr int, a double, b double")
    df.createOrReplaceTempView("some_values")
    return df


CASES = {
    "dotted(ip)": lambda: addresses.dotted(F.col("ip")),
    "endpoint_key(ip, port)": lambda: addresses.endpoint_key(F.col("ip"), F.col("port")),
    "endpoint_bits(lo)": lambda: addresses.endpoint_bits(F.col("lo")),
    "endpoint_label(lo, pr)": lambda: addresses.endpoint_label(F.col("lo"), F.col("pr")),
    "endpoint_mark(lo, pr)": lambda: addresses.endpoint_mark(F.col("lo"), F.col("pr")),
    "flow_mark(lo, hi, pr)": lambda: addresses.flow_mark(F.col("lo"), F.col("hi"), F.col("pr")),
    "session_id(lo, hi, pr, ip)": lambda: addresses.session_id(F.col("lo"), F.col("hi"), F.col("pr"), F.col("ip")),
    "feature_ratio(a, b)": lambda: ratios.feature_ratio(F.col("a"), F.col("b")),
    "fixed_width(lo, 8)": lambda: binary.fixed_width(F.col("lo"), 8),
    "fixed_width(lo, 3)": lambda: binary.fixed_width(F.col("lo"), 3),
    "hex_lower(fixed_width(ip, 4))": lambda: binary.hex_lower(binary.fixed_width(F.col("ip"), 4)),
    "unsigned(fixed_width(ip, 4))": lambda: binary.unsigned(binary.fixed_width(F.col("ip"), 4)),
    "md5_bytes(fixed_width(ip, 4))": lambda: binary.md5_bytes(binary.fixed_width(F.col("ip"), 4)),
}


@pytest.mark.parametrize("text", CASES)
def test_function(spark, values, text):
    got = [r[0] for r in spark.sql(f"SELECT {text} FROM some_values").collect()]
    assert got == [r[0] for r in values.select(CASES[text]()).collect()]


def test_queries_in_text_read_only_what_they_need(spark, values, tmp_path):
    values.write.parquet(str(tmp_path / "t"))
    sql.view(spark, "stored_values", str(tmp_path / "t"))
    plan = spark.sql("SELECT dotted(ip) x FROM stored_values WHERE port = 443")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(port,443)" in plan and "ReadSchema: struct<ip:bigint,port:bigint>" in plan and "Python" not in plan
