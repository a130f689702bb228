"""The byte, address and ratio functions for SQL text, and stored tables as views.

Every function is one SQL expression that Spark puts into the plan, so a query in text is compiled like one
in columns.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_MASK = "CASE WHEN width < 8 THEN n & (shiftleft(1L, 8 * width) - 1) ELSE n END"
_BITS = "CASE WHEN endpoint < 0 THEN endpoint + 281474976710656 ELSE endpoint END"

#: Signature, type and expression; later ones use earlier ones.
FUNCTIONS = (
    ("hex_lower(b BINARY)", "STRING", "lower(hex(b))"),
    ("unsigned(b BINARY)", "BIGINT", "CAST(conv(hex(b), 16, 10) AS BIGINT)"),
    ("fixed_width(n BIGINT, width INT)", "BINARY", f"unhex(lpad(hex({_MASK}), 2 * width, '0'))"),
    ("md5_bytes(b BINARY)", "BINARY", "unhex(md5(b))"),
    (
        "dotted(ip BIGINT)", "STRING",
        "concat_ws('.', shiftright(ip, 24) & 255, shiftright(ip, 16) & 255, shiftright(ip, 8) & 255, ip & 255)",
    ),
    (
        "endpoint_key(ip BIGINT, port BIGINT)", "BIGINT",
        "ip * 65536 + port - CASE WHEN ip * 65536 + port >= 140737488355328 THEN 281474976710656 ELSE 0 END",
    ),
    ("endpoint_bits(endpoint BIGINT)", "BIGINT", _BITS),
    (
        "endpoint_label(endpoint BIGINT, pr INT)", "STRING",
        "concat(dotted(shiftright(endpoint_bits(endpoint), 16)), ':', endpoint_bits(endpoint) & 65535, '-', pr)",
    ),
    ("endpoint_mark(endpoint BIGINT, pr INT)", "BINARY", "concat(fixed_width(endpoint, 6), fixed_width(pr, 1))"),
    (
        "flow_mark(lo BIGINT, hi BIGINT, pr INT)", "BINARY",
        "concat(fixed_width(lo, 6), fixed_width(hi, 6), fixed_width(pr, 1))",
    ),
    (
        "session_id(lo BIGINT, hi BIGINT, pr INT, sid_ts BIGINT)", "BINARY",
        "concat(flow_mark(lo, hi, pr), fixed_width(sid_ts, 8))",
    ),
    (
        "feature_ratio(a DOUBLE, b DOUBLE)", "DOUBLE",
        "CASE WHEN a IS NULL OR b IS NULL OR (a = 0 AND b = 0) THEN 1.0D WHEN b = 0 THEN 0.0D ELSE try_divide(a, b) END",
    ),
)


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to a session's SQL."""
    for signature, kind, expression in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {expression}")
    return spark


def view(spark: SparkSession, name: str, path: str) -> None:
    """The stored table at ``path`` under a name; queries still read only the columns and files they need."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} USING parquet OPTIONS (path '{path}')")
