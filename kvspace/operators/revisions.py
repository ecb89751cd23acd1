"""The revision log: decoding, key states, prefix rollups and their queries.

Revisions are ordered by (main_revision, sub_revision, value_hash) within a key. Aggregates
take one shuffle by key and then one by prefix; both combine on the map side, so a key with
many revisions or the root prefix is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvspace.functions import keys
from kvspace.operators.paging import page, page_total

ORDER = ("main_revision", "sub_revision", "value_hash")
_SUMS = ("current_key_count", "current_stored_bytes", "historical_versions", "historical_bytes", "tombstone_count", "tombstone_bytes", "key_count")


def _number(raw: Column, at: int) -> Column:
    """Eight big-endian bytes as a signed number; null where the first bit is set."""
    digits = F.hex(F.substring(raw, at, 8))
    return F.when(F.octet_length(raw) >= at + 7, F.conv(digits, 16, 10).try_cast("bigint"))


def valid_revision_key(raw: Column) -> Column:
    """17 bytes, or 18 with a ``t`` at the end; ``_`` in the middle; main above 0, sub not below 0."""
    n = F.octet_length(raw)
    shape = ((n == 17) | ((n == 18) & (F.substring(raw, 18, 1) == F.lit(b"t")))) & (F.substring(raw, 9, 1) == F.lit(b"_"))
    return F.coalesce(shape & (_number(raw, 1) > 0) & (_number(raw, 10) >= 0), F.lit(False))


def decode_revisions(raw: DataFrame, task_id: str) -> DataFrame:
    """Revisions of raw store rows, without any value. Rows with a bad revision key are left out."""
    kv, key = F.col("kv"), F.col("kv.key")
    value = F.coalesce(kv["value"], F.lit(b""))
    return raw.filter(valid_revision_key(F.col("rev_key"))).select(
        F.lit(task_id).alias("task_id"),
        F.sha2(key, 256).alias("key_hash"),
        keys.key_text(key).alias("key_text"),
        F.octet_length(key).cast("bigint").alias("key_bytes"),
        _number(F.col("rev_key"), 1).alias("main_revision"),
        _number(F.col("rev_key"), 10).alias("sub_revision"),
        kv["create_revision"].alias("create_revision"),
        kv["mod_revision"].alias("mod_revision"),
        kv["version"].alias("version"),
        kv["lease"].alias("lease_id"),
        F.octet_length(value).cast("bigint").alias("value_bytes"),
        (F.octet_length("rev_key") + F.col("encoded_bytes")).cast("bigint").alias("stored_bytes"),
        (F.octet_length("rev_key") == 18).alias("tombstone"),
        F.sha2(value, 256).alias("value_hash"),
    )


def decode_errors(raw: DataFrame) -> DataFrame:
    """Number of rows that have no good revision key."""
    return raw.agg(F.count_if(~valid_revision_key(F.col("rev_key"))).alias("decode_errors"))


def latest_revision(revisions: DataFrame) -> DataFrame:
    """The last revision of each key: a grouped maximum, so the log is reduced before it is shuffled."""
    last = revisions.groupBy("key_hash").agg(F.max_by(F.struct(*revisions.columns), F.struct(*ORDER)).alias("last"))
    return last.select("last.*")


#: Of a key's latest revision these are kept, and of all its revisions these are added up.
KEPT = ("task_id", "key_text", "key_bytes", "create_revision", "mod_revision", "version", "lease_id", "value_bytes", "stored_bytes", "tombstone")
SHARES = {
    "puts": "int(NOT tombstone)",
    "put_bytes": "if(tombstone, 0L, stored_bytes)",
    "tombstone_count": "int(tombstone)",
    "tombstone_bytes": "if(tombstone, stored_bytes, 0L)",
    "revision_count": "1",
}


def shares() -> list[Column]:
    """What each revision adds to its key's sums."""
    return [F.expr(sql).cast("bigint").alias(n) for n, sql in SHARES.items()]


def key_totals(revisions: DataFrame) -> DataFrame:
    """One row for each key: its latest revision as ``last``, and sums over all of them.

    A grouped maximum finds the latest revision, so that the log is reduced before it is shuffled.
    """
    return revisions.groupBy("key_hash").agg(F.max_by(F.struct(*KEPT), F.struct(*ORDER)).alias("last"), *[F.sum(F.expr(sql)).cast("bigint").alias(n) for n, sql in SHARES.items()])


def key_records(revisions: DataFrame) -> DataFrame:
    """One row for each key: its latest revision, and what it holds now, held before and deleted."""
    return records_of(key_totals(revisions))


def records_of(totals: DataFrame, *more: str) -> DataFrame:
    """Key records of key totals, with the columns ``more``. History is every put other than a live latest one."""
    live = ~F.col("last.tombstone")
    now = lambda c: F.when(live, F.col(f"last.{c}")).otherwise(F.lit(0).cast("bigint"))
    history = F.col("put_bytes") - now("stored_bytes")
    return totals.select(
        F.col("last.task_id").alias("task_id"),
        "key_hash",
        F.col("last.key_text").alias("key_text"),
        keys.primary_prefix(F.col("last.key_text")).alias("prefix"),
        live.alias("present"),
        *[F.col(f"last.{c}").alias(c) for c in ("create_revision", "mod_revision", "version", "lease_id")],
        now("key_bytes").alias("current_key_bytes"),
        now("value_bytes").alias("current_value_bytes"),
        now("stored_bytes").alias("current_stored_bytes"),
        (F.col("puts") - live.cast("bigint")).alias("historical_versions"),
        history.alias("historical_bytes"),
        "tombstone_count",
        "tombstone_bytes",
        "revision_count",
        (history / F.greatest(now("stored_bytes"), F.lit(1))).alias("historical_amplification"),
        *more,
    )


PREFIX_SUMS = ("current_key_count", "current_bytes", "historical_bytes", "tombstone_count")


def prefix_parts(records: DataFrame, *more: str) -> DataFrame:
    """Each key's share of each of its ancestors, with the columns ``more``; grouped sums of any split of it add up (prefix_merge)."""
    own = records.select(F.posexplode(keys.key_ancestors(F.col("key_text"))).alias("at", "prefix"), "present", "current_value_bytes", "historical_bytes", "tombstone_count", *more)
    return own.select(
        "prefix",
        (F.col("at") + 1).cast("bigint").alias("depth"),
        F.col("present").cast("bigint").alias("current_key_count"),
        F.col("current_value_bytes").alias("current_bytes"),
        "historical_bytes",
        "tombstone_count",
        F.col("current_value_bytes").alias("max_value_bytes"),
        *more,
    )


def prefix_merge(parts: DataFrame) -> DataFrame:
    """Partial prefix statistics added up: sums add, the largest value stays."""
    return parts.groupBy("prefix", "depth").agg(
        *[F.sum(c).cast("bigint").alias(c) for c in PREFIX_SUMS],
        F.max("max_value_bytes").alias("max_value_bytes"),
    )


def prefix_stats(records: DataFrame) -> DataFrame:
    return prefix_merge(prefix_parts(records))


def mvcc_summary(records: DataFrame, decode_error_rows: DataFrame | None = None) -> DataFrame:
    """One row of totals. ``decode_error_rows`` is the one-row result of decode_errors."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    out = records.agg(
        F.lit(True).alias("semantic_available"),
        total("revision_count").alias("revision_count"),
        F.count_if("present").alias("current_key_count"),
        total("current_stored_bytes").alias("current_stored_bytes"),
        total("historical_versions").alias("historical_versions"),
        total("historical_bytes").alias("historical_bytes"),
        total("tombstone_count").alias("tombstone_count"),
        total("tombstone_bytes").alias("tombstone_bytes"),
        F.count("*").alias("key_count"),
    )
    return out if decode_error_rows is None else out.crossJoin(F.broadcast(decode_error_rows))


def semantic_unavailable(gate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, finding) for the rows (task_id, version, source) whose version does not pass the gate."""
    shut = gate.filter(~F.coalesce(keys.semantic_gate(F.col("version"), F.col("source")), F.lit(False)))
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("revision_count", *_SUMS)]
    summary = shut.select("task_id", F.lit(False).alias("semantic_available"), *zero)
    finding = shut.select("task_id", F.lit("semantic_decode_unavailable").alias("rule"), F.lit("info").alias("severity"))
    return summary, finding


KEY_SORTS = {"key": "key_text", "current_bytes": "current_stored_bytes", "historical_bytes": "historical_bytes", "revision_count": "revision_count", "tombstone_count": "tombstone_count"}


def filter_keys(records: DataFrame, prefix: str = "", min_total_bytes: int = 0, min_revisions: int = 0, tombstones_only: bool = False) -> DataFrame:
    out = records
    if prefix:
        out = out.filter(keys.starts_with_prefix(F.col("key_text"), prefix))
    if min_total_bytes:
        out = out.filter(F.col("current_stored_bytes") + F.col("historical_bytes") + F.col("tombstone_bytes") >= min_total_bytes)
    if min_revisions:
        out = out.filter(F.col("revision_count") >= min_revisions)
    return out.filter(F.col("tombstone_count") > 0) if tombstones_only else out


def query_keys(records: DataFrame, sort: str = "historical_bytes", descending: bool = True, number: int = 1, size: int = 100, **filters) -> DataFrame:
    return page(filter_keys(records, **filters), KEY_SORTS, sort, descending, ("key_hash",), number, size)


def query_keys_total(records: DataFrame, **filters) -> DataFrame:
    return page_total(filter_keys(records, **filters))


def key_revisions(revisions: DataFrame, key_hash: str, number: int = 1, size: int = 100) -> DataFrame:
    """A key's revisions, newest first."""
    return page(revisions.filter(F.col("key_hash") == key_hash), {"main_revision": "main_revision"}, "main_revision", True, ("-sub_revision", "-value_hash"), number, size)


def get_key(records: DataFrame, key_hash: str) -> DataFrame:
    return records.filter(F.col("key_hash") == key_hash)


def top_prefixes(stats: DataFrame, n: int) -> DataFrame:
    return stats.orderBy(F.desc("historical_bytes"), F.desc("current_bytes"), "prefix").limit(n)
