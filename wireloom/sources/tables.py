"""Table scans, writes and keyed merges over columnar files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wireloom.functions.binary import hex_spaced
from wireloom.sources.keyed import ROW_GROUP_BYTES, clustered_writer


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


_BIN, _LONG, _INT, _STR = T.BinaryType(), T.LongType(), T.IntegerType(), T.StringType()
_PAIR = _fields(("frac", T.DoubleType()), ("mean", T.DoubleType()))
_KEY = (("lo", _LONG), ("hi", _LONG), ("pr", _INT))

RAW_PACKETS = _fields(("rowkey", _BIN), ("t", _LONG), ("r", _BIN))
SESSIONS = _fields(
    ("rowkey", _BIN), *_KEY, ("sid_ts", _LONG), ("sport", _INT), ("dport", _INT),
    ("direction", _BIN), ("m", _BIN), ("server", _LONG), ("sid", _BIN),
    ("features_name", T.ArrayType(_STR)), ("features_value", T.ArrayType(T.DoubleType())),
)
PROFILES = _fields(
    ("rowkey", _BIN), ("m", _BIN), ("id", _STR), ("features_name", T.ArrayType(_STR)),
    ("features_value", T.ArrayType(_PAIR)), ("keywords", _STR),
)
MODELS = _fields(
    ("id", _STR), ("features_name", T.ArrayType(_STR)),
    ("features_value", T.ArrayType(_PAIR)), ("keywords", _STR),
)
CATALOG_RECORDS = _fields(("key", _STR), ("r", _STR), ("p", _BIN))


def scan(
    spark: SparkSession,
    path: str,
    columns: Iterable[str] = (),
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read the named columns of a table; only those columns leave the files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    table = reader.parquet(path)
    columns = list(columns)
    return table.select(*columns) if columns else table


def write(df: DataFrame, path: str, columns: Iterable[str] = (), mode: str = "overwrite") -> None:
    columns = list(columns)
    (df.select(*columns) if columns else df).write.mode(mode).parquet(path)


def write_records(
    df: DataFrame, path: str, regions: int | None = None, mode: str = "overwrite"
) -> None:
    """Write records in the declared layout; ``regions`` asks for that many files by key.

    Without it rows are written where they are, so the work spreads with their number.
    """
    shaped = df.select(*[F.col(f.name).cast(f.dataType) for f in CATALOG_RECORDS])
    placed = shaped if regions is None else shaped.repartition(regions, "key")
    placed.write.mode(mode).parquet(path)


def with_literal(df: DataFrame, name: str, value: bytes) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text starts with ``prefix``; the filter reaches the scan."""
    return df.where(F.col(column).startswith(prefix))


def with_key(df: DataFrame, column: str, key: str | int) -> DataFrame:
    """Rows of one key: hex text for a binary key, a number otherwise.  Pushed to the scan."""
    value: Column = F.unhex(F.lit(key)) if isinstance(key, str) else F.lit(key)
    return df.where(F.col(column) == value)


def present(df: DataFrame, column: str) -> DataFrame:
    """Rows where the column is not null; the filter reaches the scan."""
    return df.where(F.col(column).isNotNull())


def with_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies between two bounds, both included."""
    return df.where(F.col(column).between(low, high))


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def preview(df: DataFrame, key: str, column: str, n: int = 2) -> DataFrame:
    """The first rows by key, bytes as spaced hex."""
    return first_rows(df.select(key, column), key, n).select(
        hex_spaced(F.col(key)).alias(key), hex_spaced(F.col(column)).alias(column)
    )


def merge_by_key(base: DataFrame, *updates: DataFrame, key: str = "rowkey") -> DataFrame:
    """Columns of several results put into the rows of one table, by key.

    Where an update has a column the table already has, its non-null values win.
    """
    for update in updates:
        shared = [c for c in update.columns if c != key and c in base.columns]
        renamed = update.withColumnsRenamed({c: f"updated_{c}" for c in shared})
        base = base.join(renamed, key, "left").withColumns(
            {c: F.coalesce(f"updated_{c}", c) for c in shared}
        )
        base = base.drop(*[f"updated_{c}" for c in shared])
    return base


def write_clustered(
    df: DataFrame, path: str, key: str = "rowkey", mode: str = "overwrite", row_group_bytes: int = ROW_GROUP_BYTES
) -> None:
    """Write files that hold ranges of sorted keys and carry Bloom filters, for look-ups of single keys."""
    ranged = df.repartitionByRange(key).sortWithinPartitions(key)
    clustered_writer(ranged, key, row_group_bytes).mode(mode).parquet(path)


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int, key: str = "rowkey") -> DataFrame:
    """The table ``name`` at ``path``, one file per bucket of the key; tables of as many buckets merge without a shuffle."""
    placed = df.repartition(buckets, key)
    placed.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def merge_buckets(base: DataFrame, *updates: DataFrame, key: str = "rowkey") -> DataFrame:
    """``merge_by_key`` of bucketed tables, bucket by bucket."""
    return merge_by_key(base, *(u.hint("merge") for u in updates), key=key)
