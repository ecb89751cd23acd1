"""Differences of two analysed snapshots.

Rows are aligned by full outer joins on the key; both sides are one row for each key, so
the joins do not grow. Sides of different kinds never multiply.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspace.functions import keys
from kvspace.operators.paging import page

PHYSICAL = ("physical_file_size", "page_size", "page_count", "in_use_page_bytes", "free_page_bytes", "fragmentation_ratio", "meta_pages", "branch_pages", "leaf_pages", "freelist_pages", "overflow_pages", "free_pages", "unknown_pages")
MVCC = ("revision_count", "current_key_count", "current_stored_bytes", "historical_versions", "historical_bytes", "tombstone_count", "tombstone_bytes")
KUBE = ("current_objects", "current_bytes", "historical_bytes")


def change_type(base: Column, target: Column) -> Column:
    """From each side's presence, null where it has no row: what is there at last decides between added and deleted."""
    was, now = F.coalesce(base, F.lit(False)), F.coalesce(target, F.lit(False))
    return (
        F.when(target.isNull(), "deleted")
        .when(base.isNull(), F.when(now, "added").otherwise("deleted"))
        .when(was & ~now, "deleted").when(~was & now, "added").otherwise("modified")
    )


def full_outer_align(base: DataFrame, target: DataFrame, on: list[str], identity: list[str], measures: dict[str, str], present: Column | None = None) -> DataFrame:
    """Aligned rows with change_type and a delta for each measure (new name: column).

    Identity columns come from the target, for deleted rows with a base row from the base.
    ``present`` tells which rows of a side count as there; all, if it is not given.
    """
    there = F.lit(True) if present is None else present
    side = lambda df, name: df.select(*on, F.struct(there.alias("present"), *identity, *set(measures.values())).alias(name))
    both = side(base, "b").join(side(target, "t"), on, "full")
    kind = change_type(F.col("b.present"), F.col("t.present"))
    own = lambda c: F.when((kind == "deleted") & F.col("b").isNotNull(), F.col(f"b.{c}")).otherwise(F.coalesce(F.col(f"t.{c}"), F.col(f"b.{c}")))
    delta = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit(0)) - F.coalesce(F.col(f"b.{c}"), F.lit(0))
    return both.select(*on, *[own(c).alias(c) for c in identity], kind.alias("change_type"), *[delta(c).alias(n) for n, c in measures.items()])


def _with_total(df: DataFrame, *parts: str) -> DataFrame:
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return df.withColumn("total_bytes_delta", total)


def diff_keys(base: DataFrame, target: DataFrame) -> DataFrame:
    """Keys; a modified row in which nothing changed is left out."""
    measures = {"current_bytes_delta": "current_stored_bytes", "historical_bytes_delta": "historical_bytes", "tombstone_bytes_delta": "tombstone_bytes", "revision_count_delta": "revision_count"}
    out = _with_total(full_outer_align(base, target, ["key_hash"], ["key_text", "prefix"], measures, F.col("present")), "current_bytes_delta", "historical_bytes_delta", "tombstone_bytes_delta")
    still = (F.col("change_type") == "modified") & (F.abs("current_bytes_delta") + F.abs("historical_bytes_delta") + F.abs("tombstone_bytes_delta") + F.abs("revision_count_delta") == 0)
    return out.filter(~still)


def diff_objects(base: DataFrame, target: DataFrame) -> DataFrame:
    identity = ["api_group", "resource", "namespace", "display_name"]
    measures = {"current_bytes_delta": "current_bytes", "historical_bytes_delta": "historical_bytes", "revision_count_delta": "revision_count"}
    out = _with_total(full_outer_align(base, target, ["key_hash"], identity, measures, F.col("present")), "current_bytes_delta", "historical_bytes_delta")
    still = (F.col("change_type") == "modified") & (F.abs("current_bytes_delta") + F.abs("historical_bytes_delta") + F.abs("revision_count_delta") == 0)
    return out.filter(~still)


def diff_prefixes(base: DataFrame, target: DataFrame) -> DataFrame:
    measures = {"current_bytes_delta": "current_bytes", "historical_bytes_delta": "historical_bytes", "current_key_count_delta": "current_key_count", "tombstone_count_delta": "tombstone_count"}
    return _with_total(full_outer_align(base, target, ["prefix"], ["depth"], measures), "current_bytes_delta", "historical_bytes_delta").drop("change_type")


def _diff_rollup(base: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    measures = {"current_objects_delta": "current_objects", "current_bytes_delta": "current_bytes", "historical_bytes_delta": "historical_bytes"}
    return _with_total(full_outer_align(base, target, on, [], measures), "current_bytes_delta", "historical_bytes_delta").drop("change_type")


def diff_resources(base: DataFrame, target: DataFrame) -> DataFrame:
    return _diff_rollup(base, target, ["api_group", "resource"])


def diff_namespaces(base: DataFrame, target: DataFrame) -> DataFrame:
    return _diff_rollup(base, target, ["namespace"])


def _one_row(base: DataFrame, target: DataFrame, columns: tuple[str, ...], extra: list[str]) -> DataFrame:
    """Base and target, of at most one row each, side by side with a row even if both are empty."""
    side = lambda df, n: df.limit(1).agg(F.first(F.struct(*columns, *extra)).alias(n))
    return side(base, "b").crossJoin(side(target, "t"))


def diff_physical(base: DataFrame, target: DataFrame) -> DataFrame:
    """One row of deltas, or the side that is missing."""
    both = _one_row(base, target, PHYSICAL, [])
    reason = F.when(F.col("b").isNull(), "baseline physical analysis unavailable").when(F.col("t").isNull(), "target physical analysis unavailable").otherwise("")
    return both.select((reason == "").alias("physical_available"), reason.alias("physical_unavailable_reason"), *[F.coalesce(F.col(f"t.{c}") - F.col(f"b.{c}"), F.lit(0)).alias(f"{c}_delta") for c in PHYSICAL])


def _gated(base: DataFrame, target: DataFrame, columns: tuple[str, ...], base_version: str, target_version: str) -> tuple[DataFrame, Column]:
    both = _one_row(base, target, columns, ["semantic_available"])
    ok = F.coalesce(F.col("b.semantic_available") & F.col("t.semantic_available"), F.lit(False)) & keys.compatible_versions(F.lit(base_version), F.lit(target_version))
    return both, ok


def diff_mvcc_summary(base: DataFrame, target: DataFrame, base_version: str, target_version: str, window_seconds: int | None = None) -> DataFrame:
    """One row of deltas if both sides could be decoded and their versions go together; the rate needs a window."""
    both, ok = _gated(base, target, MVCC, base_version, target_version)
    delta = lambda c: F.when(ok, F.col(f"t.{c}") - F.col(f"b.{c}")).otherwise(F.lit(0).cast("bigint"))
    seconds = int(window_seconds or 0)
    rate = F.when(ok & F.lit(seconds > 0), delta("revision_count") / F.lit(max(seconds, 1)))
    return both.select(ok.alias("mvcc_available"), *[delta(c).alias(f"{c}_delta") for c in MVCC], F.when(ok & F.lit(seconds > 0), F.lit(seconds).cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("observation_window_seconds"), rate.alias("average_revisions_per_second"))


def diff_kube_summary(base: DataFrame, target: DataFrame, base_version: str, target_version: str) -> DataFrame:
    both, ok = _gated(base, target, KUBE, base_version, target_version)
    return both.select(ok.alias("kube_available"), *[F.when(ok, F.col(f"t.{c}") - F.col(f"b.{c}")).otherwise(F.lit(0).cast("bigint")).alias(f"{c}_delta") for c in KUBE])


def validate_window(base_at: datetime | None, target_at: datetime | None) -> int | None:
    """Whole seconds between the observation times: both or neither are given, a second apart at least."""
    if (base_at is None) != (target_at is None):
        raise ValueError("both observation times or none")
    if base_at is None or target_at is None:
        return None
    seconds = int((target_at - base_at).total_seconds())
    if seconds < 1:
        raise ValueError("the target must be observed at least a second after the baseline")
    return seconds


KEY_DELTA_SORTS = {"key": "key_text", "total": "total_bytes_delta", "current": "current_bytes_delta", "history": "historical_bytes_delta", "tombstone": "tombstone_bytes_delta", "revision_count": "revision_count_delta"}
OBJECT_DELTA_SORTS = {"object": "display_name", "total": "total_bytes_delta", "current": "current_bytes_delta", "history": "historical_bytes_delta", "revision_count": "revision_count_delta"}


def query_key_deltas(deltas: DataFrame, change: str | None = None, prefix: str = "", sort: str = "total", descending: bool = True, number: int = 1, size: int = 100) -> DataFrame:
    out = deltas if change is None else deltas.filter(F.col("change_type") == change)
    if prefix:
        out = out.filter(keys.starts_with_prefix(F.col("key_text"), prefix))
    return page(out, KEY_DELTA_SORTS, sort, descending, ("key_hash",), number, size)


def query_object_deltas(deltas: DataFrame, change: str | None = None, api_group: str | None = None, resource: str | None = None, namespace: str | None = None, sort: str = "total", descending: bool = True, number: int = 1, size: int = 100) -> DataFrame:
    out = deltas
    for column, value in (("change_type", change), ("api_group", api_group), ("resource", resource), ("namespace", namespace)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return page(out, OBJECT_DELTA_SORTS, sort, descending, ("key_hash",), number, size)


def _top(deltas: DataFrame, n: int, growth: bool, *ties: str) -> DataFrame:
    if not 1 <= n <= 500:
        raise ValueError("between 1 and 500 rows")
    return deltas.orderBy(F.desc("total_bytes_delta") if growth else F.asc("total_bytes_delta"), *ties).limit(n)


def top_prefix_deltas(deltas: DataFrame, n: int, growth: bool = True) -> DataFrame:
    return _top(deltas, n, growth, "prefix")


def top_resource_deltas(deltas: DataFrame, n: int, growth: bool = True) -> DataFrame:
    return _top(deltas, n, growth, "api_group", "resource")


def top_namespace_deltas(deltas: DataFrame, n: int, growth: bool = True) -> DataFrame:
    return _top(deltas, n, growth, "namespace")


def churn_per_hour(deltas: DataFrame, n: int, window_seconds: int | None) -> DataFrame:
    """Keys with the most new revisions; the rate is null without a window."""
    rate = F.col("revision_count_delta") / F.lit(window_seconds) * 3600 if window_seconds else F.lit(None).cast("double")
    return deltas.select("key_hash", "key_text", "revision_count_delta", rate.alias("revisions_per_hour")).orderBy(F.desc("revision_count_delta"), "key_hash").limit(n)
