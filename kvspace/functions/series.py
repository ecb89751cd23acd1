"""Metric names, series identity and histogram bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Metric name, type, whether the name is the stable one.
NAMES = (
    ("etcd_mvcc_db_total_size_in_bytes", "db_total_bytes", True),
    ("etcd_debugging_mvcc_db_total_size_in_bytes", "db_total_bytes", False),
    ("etcd_mvcc_db_total_size_in_use_in_bytes", "db_in_use_bytes", True),
    ("etcd_server_quota_backend_bytes", "quota_bytes", True),
    ("etcd_mvcc_put_total", "put_total", True),
    ("etcd_debugging_mvcc_put_total", "put_total", False),
    ("etcd_mvcc_delete_total", "delete_total", True),
    ("etcd_debugging_mvcc_delete_total", "delete_total", False),
    ("etcd_disk_backend_commit_duration_seconds_bucket", "backend_commit_seconds", True),
    ("etcd_disk_wal_fsync_duration_seconds_bucket", "wal_fsync_seconds", True),
)
HISTOGRAMS = ("backend_commit_seconds", "wal_fsync_seconds")


def metric_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NAMES, "name string, metric_type string, stable boolean")


def normalize_metric(df: DataFrame, name: str) -> DataFrame:
    """df with metric_type and stable, null for names that are not supported; the ten names are broadcast."""
    return df.join(F.broadcast(metric_names(df.sparkSession).withColumnRenamed("name", name)), name, "left")


def series_identity(metric_type: Column, labels: Column) -> Column:
    label = lambda n: F.coalesce(F.try_element_at(labels, F.lit(n)), F.lit(""))
    return F.sha2(F.concat_ws("\x00", metric_type, label("instance"), label("job"), label("member_id"), label("le")), 256)


def histogram_bound(le: Column) -> Column:
    """Upper bound of a bucket: infinity for ``+Inf``, else a finite number of at least 0, else null."""
    number = F.when(le.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), le.try_cast("double"))
    return F.when(le == "+Inf", F.lit(float("inf"))).when((number >= 0) & (number < float("inf")), number)
