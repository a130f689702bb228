"""Intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql.streaming import DataStreamWriter

CHECKPOINT_DIR = "spark.checkpoint.dir"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Work on tables of more stored bytes than ``ROUND_BYTES`` goes round by round, in up to ``ROUNDS`` of them, so that what
#: lies beside the tables meanwhile (shuffles, copies) is that of one round.
ROUND_BYTES = 256 * 1024 * 1024
ROUNDS = 16


#: Folders of applications that name none, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset all tasks have to run on this machine, and a temporary folder is used as long as the
    application lives; a cluster has to name a folder its executors share.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        master, application = spark.sparkContext.master, spark.sparkContext.applicationId
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_DIR} must name a shared folder when the master is {master}")
        # The setting itself cannot be changed in a running session.
        folder = _own.setdefault(application, _own.get(application) or tempfile.mkdtemp(prefix="wireloom-"))
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/wireloom/{name}-{uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries in here leave no shuffle files; Spark else keeps them until the driver happens to collect its garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def compact(writer: DataFrameWriter | DataStreamWriter) -> DataFrameWriter | DataStreamWriter:
    """The writer, of a table or a stream, with the codec of large tables of packets and of all in the shared folder."""
    return writer.option("compression", "zstd")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends here and later passes prune columns."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with shuffles_dropped(spark):
        compact(df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """What Spark takes ``df`` to have: of a whole stored table the bytes of its files, of rows it knows nothing about very many."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def rounds_of(size: int, most: int = ROUNDS) -> int:
    """In how many rounds work on so many stored bytes goes: a power of two, or ``most``."""
    n = 1
    while n < most and n * ROUND_BYTES < size:
        n *= 2
    return min(n, most)


def emptied(spark: SparkSession, path: str) -> None:
    """Leave nothing in a folder that was only written to be read again."""
    none = spark.createDataFrame([], "none int")
    none.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
