"""Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from kvspace.functions.logtext import log_normalize
from kvspace.operators import revisions as R
from kvspace.streaming import state as keyed
from kvspace.streaming.state import STORE, BestOnce, Differences

cloudpickle.register_pickle_by_value(keyed)  # a stream's planning worker gets no files of the application


_PARTITIONS = "spark.sql.shuffle.partitions"
#: Parts of the ids of audit events in the state.
PARTS = 1_024


def log_events_stream(lines: DataFrame, text: str = "value") -> DataFrame:
    """Events of arriving log lines; without state. Line numbers are not known in a stream."""
    good = lines.filter(F.is_valid_utf8(text) & (F.octet_length(text) <= 1 << 20)).select(F.col(text).alias("line"))
    return log_normalize(good, "line").select("e.*")


def _stated(df: DataFrame) -> DataFrame:
    """df, once its session keeps streams' state where keyed state can be."""
    df.sparkSession.conf.set(*STORE)
    return df


def audit_dedup_stream(events: DataFrame, delay: str = "1 day", parts: int = PARTS) -> DataFrame:
    """The best stage of each audit id, told once, in append mode.

    An id is told when the newest event seen is two ``delay`` past the id's last one (one for
    the watermark, one for its timer), and forgotten one later; stages of an id that lie at most
    a ``delay`` apart are always one row, on whatever day. Rows older than the newest event of
    the batches before by more than ``delay`` drop, so do stragglers of an id that has been told.
    State holds the ids of three delays in ``parts`` parts (for as long as the stream's folder is
    used); a part is held and written whole, so it should be some thousand ids. A row of ``end_of_events`` at the end lets all ids be
    told, so that on the same input without late rows the result equals that of ``audit_dedup``.
    """
    hold = int(events.sparkSession.sql(f"SELECT cast(unix_millis(timestamp_seconds(0) + INTERVAL '{delay}') AS bigint)").first()[0])
    timed = _stated(events).withWatermark("observed_at", delay).withColumns({"_at": F.unix_millis("observed_at"), "_first": -F.col("line_number")})
    ids = ("task_id", "audit_id_hash")
    columns = StructType([*events.schema.fields, *timed.schema.fields[-2:]])
    grouped = timed.withColumn("_part", F.pmod(F.xxhash64(*ids), F.lit(parts))).groupBy("_part")
    best = grouped.transformWithState(BestOnce(columns, ids, "_at", ("stage_rank", "_first"), hold), columns, "append", "EventTime")
    return best.drop("_at", "_first")


def end_of_events(events: DataFrame) -> DataFrame:
    """A row without an id, so late that all ids before it are told."""
    far = F.lit("9999-01-01").cast("timestamp")
    names = {"observed_at": far}
    return events.sparkSession.range(1).select(*[names.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields])


def run_available(stream: DataFrame, folder: str, mode: str = "append", reduce: Callable[[DataFrame], DataFrame] | None = None, partitions: int | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns all that it told, with its batch number ``batch``.

    Each batch is a folder of its own that is written anew if the batch is run again, so a
    batch that is repeated after a failure leaves its rows once. ``reduce`` is applied to
    each batch before it is written. ``partitions`` is how many parts keyed state has, for as long
    as the stream's folder is used; by default as many as a shuffle.
    """
    spark = stream.sparkSession
    usual = spark.conf.get(_PARTITIONS)
    if partitions is not None:
        spark.conf.set(_PARTITIONS, partitions)
    schema = (reduce(stream) if reduce else stream).schema

    def store(rows: DataFrame, batch: int) -> None:
        (reduce(rows) if reduce else rows).write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    try:  # a query takes the settings of its start
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(store).start()
    finally:
        spark.conf.set(_PARTITIONS, usual)
    query.awaitTermination()
    return spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/out")


def key_changes_stream(revisions: DataFrame) -> DataFrame:
    """Key totals (as of ``key_totals``) with ``sign``: of each key that a batch touches the old ones (-1) and the new ones (1).

    The state has one row for each key. Totals are kept by key alone, so a key's revisions may
    arrive in any number of batches and in any order.
    """
    own = _stated(revisions).select("key_hash", *R.ORDER, *R.KEPT, *R.shares())
    totals = StructType([f for f in own.schema.fields if f.name != "key_hash"])
    out = StructType([*own.schema.fields, StructField("sign", IntegerType())])
    return own.groupBy("key_hash").transformWithState(Differences(totals, out, R.ORDER, R.KEPT, tuple(R.SHARES)), out, "update", "None")


def prefix_stats_stream(revisions: DataFrame) -> DataFrame:
    """What arriving revisions change in the statistics of prefixes, in update mode: old shares taken out, new ones put in.

    ``prefix_differences`` adds rows up (for each batch, and again over all of them), and
    ``prefix_current`` gives the statistics after all that has been told.
    """
    return R.prefix_parts(R.records_of(key_changes_stream(revisions).withColumn("last", F.struct(*R.KEPT)), "sign"), "sign")


def prefix_differences(parts: DataFrame) -> DataFrame:
    """Signed shares added up by prefix and value size; a largest value can be taken out again only if its size is counted."""
    sums = [F.sum(F.col("sign") * F.col(c)).cast("bigint").alias(c) for c in R.PREFIX_SUMS]
    told = "n" if "n" in parts.columns else None
    counted = parts.withColumn("sign", F.lit(1)) if told else parts
    sums = [F.sum(c).cast("bigint").alias(c) for c in R.PREFIX_SUMS] if told else sums
    return counted.groupBy("prefix", "depth", "max_value_bytes").agg(*sums, F.sum(told or "sign").cast("bigint").alias("n"))


def prefix_current(differences: DataFrame) -> DataFrame:
    """Prefix statistics of all differences told: sums, and the largest value that some key still has."""
    return prefix_differences(differences).groupBy("prefix", "depth").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in R.PREFIX_SUMS],
        F.max(F.when(F.col("n") > 0, F.col("max_value_bytes"))).alias("max_value_bytes"),
    )
