"""Where intermediate tables go: the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from kvspace.session import scratch_dir, shared_base


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, where checkpoints go too."""
    base = shared_base(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    This cuts the lineage: when an executor is lost, later stages read the table again
    and nothing before it is recomputed.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch, about. Spark's own bounds (10,000 rows, 64 MB) let a row group of texts through whole.
BATCH = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside hands its rows to Python in batches of about BATCH bytes, where the session sets no size itself."""
    if spark.conf.get(_BATCH, None) is not None:
        yield
        return
    spark.conf.set(_BATCH, str(BATCH))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH)


_BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


@contextmanager
def shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """What is run inside joins by shuffles, however small a side is.

    A chain of many small joins would otherwise gather and broadcast dozens of tables through the
    driver, each with a job, a thread and some MB of its own.
    """
    before = spark.conf.get(_BROADCAST, None)
    spark.conf.set(_BROADCAST, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BROADCAST)
        else:
            spark.conf.set(_BROADCAST, before)


def cut(df: DataFrame) -> DataFrame:
    """Eager checkpoint for small tables inside loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
