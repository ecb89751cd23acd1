"""Readers of exported stores, logs, audit trails, metric matrices and inventories; and the writer of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvspace import schemas
from kvspace.functions.logtext import MAX_LINE
from kvspace.session import ship_package
from kvspace.sources import files

MAX_AUDIT_LINE, MAX_EXPANDED = 8 << 20, 100 << 30
MAX_SERIES, MAX_SAMPLES = 5_000, 50_000_000


def read_kv_revisions(spark: SparkSession, path: str) -> DataFrame:
    """Raw revisions of an exported store: rev_key, kv, encoded_bytes."""
    return spark.read.schema(schemas.KV).parquet(path)


def _lines(spark: SparkSession, path: str, longest: int, **options: int) -> DataFrame:
    """(file, line_number, line, overlong): numbers count the lines of a file from 1; an overlong line has no text.

    Lines end with a line feed; gzip is told by a file's first bytes. A line is bounded while it
    is read. Stores that only Spark can open are read by its own text reader, which bounds a
    line afterwards and tells gzip by the suffix.
    """
    if files.file_system(path) is None:
        long = F.octet_length("line") > longest
        return _numbered(spark, path).select("file", "line_number", F.when(~long, F.col("line")).alias("line"), long.alias("overlong"))
    ship_package(spark)
    spark.dataSource.register(files.Lines)
    read = spark.read.format(files.Lines.name()).options(path=path, longest=longest, **options).load()
    if all(number == 0 for _, number, _, _ in files.splits(path, options.get("split", files.SPLIT))):
        return read.select("file", F.col("number").alias("line_number"), "line", "overlong")
    sizes = read.groupBy("file", "part").agg(F.count("*").alias("_n"))
    return _after_parts(read, sizes, "part").select("file", (F.col("number") + F.col("_start")).alias("line_number"), "line", "overlong")


def _after_parts(read: DataFrame, sizes: DataFrame, part: str) -> DataFrame:
    """read with ``_start``, the rows (_n) of the parts of its file before its own: one row for each part is summed up."""
    before = Window.partitionBy("file").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return read.join(starts, ["file", part])


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number in their file, without one task for a file.

    Lines are numbered inside each input split in reading order, and the splits' sizes are
    summed up by file; gzip files are one split and known by their suffix.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"))
    sizes = read.groupBy("file", "at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    return _after_parts(read, sizes, "at").select("file", "line", (F.col("_id") - F.col("_first") + F.col("_start") + 1).alias("line_number"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, MAX_LINE)


def read_audit_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_log_lines``; a gzip file that expands to more than MAX_EXPANDED bytes is an error."""
    return _lines(spark, path, MAX_AUDIT_LINE, expanded=MAX_EXPANDED)


def checked_matrix(envelopes: DataFrame, max_series: int = MAX_SERIES, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """Series of range-query envelopes: series_id, metric, values. A bad envelope, or one too large, is an error."""
    result = F.col("data.result")
    samples = F.aggregate(result, F.lit(0).cast("bigint"), lambda a, s: a + F.greatest(F.size(s["values"]), F.lit(0)))
    problem = (
        F.when(F.col("status").isNull() | (F.col("status") != "success"), "response status is not success")
        .when(F.col("data.resultType").isNull() | (F.col("data.resultType") != "matrix"), "resultType must be matrix")
        .when(result.isNull(), "matrix result is missing")
        .when(F.size(result) > max_series, "series limit exceeded")
        .when(samples > max_samples, "sample limit exceeded")
    )
    checked = F.when(problem.isNull(), result).otherwise(F.raise_error(problem).cast("array<struct<metric:map<string,string>,values:array<array<string>>>>"))
    return envelopes.select(F.posexplode(checked).alias("series_id", "s")).select("series_id", "s.metric", "s.values")


def read_metric_matrix(spark: SparkSession, path: str, max_series: int = MAX_SERIES, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """Series of the envelopes in files, read series by series: series_id, metric, values. A bad envelope, or one too large, is an error.

    Envelopes in stores that only Spark can open are read whole.
    """
    if files.file_system(path) is None:
        return checked_matrix(spark.read.schema(schemas.MATRIX).option("multiLine", True).json(path), max_series, max_samples)
    ship_package(spark)
    spark.dataSource.register(files.Matrix)
    return spark.read.format(files.Matrix.name()).options(path=path, series=max_series, samples=max_samples).load()


def read_page_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_bucket_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BUCKETS).parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Writes each table under path; the tasks (task_id) that a table holds replace those written before, others stay."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(f"{path}/{name}")


def read_table(spark: SparkSession, path: str, name: str, task_id: str | None = None) -> DataFrame:
    """A written table, or one task of it; only that task's folder is read."""
    df = spark.read.parquet(f"{path}/{name}").withColumn("task_id", F.col("task_id").cast("string"))
    return df if task_id is None else df.filter(F.col("task_id") == task_id)
