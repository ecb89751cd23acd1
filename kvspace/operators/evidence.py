"""Evidence: what logs, requests and metrics show in the window of a diff.

Evidence is joined in time only; it establishes no cause.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspace.functions.requests import WRITE_VERBS
from kvspace.operators.logs import log_counts, timeline_page, window_membership
from kvspace.session import scratch_dir

#: Rows of a growth set up to which it is broadcast; larger ones are joined by their keys.
BROADCAST_ROWS = 200_000
_RANKS = {"high": 3, "medium": 2, "low": 1}


def evidence_coverage(first: Column, last: Column, start: datetime, end: datetime) -> Column:
    a, b = F.lit(start), F.lit(end)
    return F.when(first.isNull() | last.isNull(), "unknown").when((last <= a) | (first > b), "none").when((first <= a) & (last >= b), "full").otherwise("partial")


def log_evidence(events: DataFrame, summary: DataFrame, start: datetime, end: datetime, number: int = 1, size: int = 100) -> dict[str, DataFrame]:
    """items (a page of the window), counts of the whole window, and one row of total and coverage."""
    inside = events.filter(window_membership(F.col("observed_at"), start, end))
    head = summary.select(evidence_coverage(F.col("first_observed_at"), F.col("last_observed_at"), start, end).alias("coverage"), F.lit("unverified").alias("source_compatibility"), F.lit(True).alias("evidence_only"))
    return {"items": timeline_page(inside, number, size), "counts": log_counts(inside), "head": inside.agg(F.count("*").alias("total")).crossJoin(F.broadcast(head.limit(1)))}


def growth_sets(objects: DataFrame, resources: DataFrame, namespaces: DataFrame) -> dict[str, DataFrame]:
    """Distinct keys that grew: objects, scopes (group, resource, namespace), resources, namespaces."""
    grown = objects.filter((F.col("total_bytes_delta") > 0) | (F.col("revision_count_delta") > 0))
    more = (F.col("total_bytes_delta") > 0) | (F.col("current_objects_delta") > 0)
    return {
        "objects": grown.select(F.col("key_hash").alias("object_key_hash")).distinct(),
        "scopes": grown.select("api_group", "resource", "namespace").distinct(),
        "resources": resources.filter(more).select("api_group", "resource").distinct(),
        "namespaces": namespaces.filter(more).select("namespace").distinct(),
    }


def match_growth_sets(events: DataFrame, sets: dict[str, DataFrame], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """events with a flag for each set: in_objects, in_scopes, in_resources, in_namespaces.

    Sets are stored once, for they come out of diffs of whole snapshots and are read twice: each
    is counted; a small one is broadcast, a large one is left to a join by its key.
    """
    out, folder = events, scratch_dir(events.sparkSession, "sets")
    for name, found in sets.items():
        found.write.parquet(f"{folder}/{name}")
        df = events.sparkSession.read.schema(found.schema).parquet(f"{folder}/{name}")
        keyed = df.withColumn(f"in_{name}", F.lit(True))
        if df.limit(broadcast_rows + 1).count() <= broadcast_rows:
            keyed = F.broadcast(keyed)
        out = out.join(keyed, df.columns, "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    return out.select(*events.columns, *[f"in_{n}" for n in sets])


def audit_match_level() -> Column:
    """From the flags: the object itself, its scope (or resource and namespace), one of the two, or nothing."""
    place = F.col("in_namespaces") & (F.col("namespace") != "")
    return (
        F.when(F.col("in_objects") & (F.col("object_key_hash") != ""), "high")
        .when(F.col("in_scopes") | (F.col("in_resources") & place), "medium")
        .when(F.col("in_resources") | place, "low")
        .otherwise("unverified")
    )


def match_rank(level: Column) -> Column:
    out = F.lit(0)
    for name, rank in _RANKS.items():
        out = F.when(level == name, rank).otherwise(out)
    return out


def audit_candidates(matched: DataFrame) -> DataFrame:
    """By user, agent and address: what they wrote that matches growth. Shown values are those of the newest event."""
    level = F.col("match_level")
    counted = lambda flag: F.count_if((level == "medium") | ((level == "low") & F.col(flag)))
    shown = F.max_by(F.struct("username", "user_agent", "source_network"), F.struct("observed_at", "line_number"))
    return matched.filter(level != "unverified").groupBy("username_hash", "user_agent_hash", "source_ip_hash").agg(
        shown.alias("s"),
        F.count("*").alias("writes"),
        F.sum("request_object_bytes").alias("request_object_bytes"),
        F.sum("response_object_bytes").alias("response_object_bytes"),
        F.max(match_rank(level)).alias("_rank"),
        F.count_if(level == "high").alias("exact_object_matches"),
        counted("in_resources").alias("resource_matches"),
        counted("in_namespaces").alias("namespace_matches"),
    ).select(
        "s.*", "username_hash", "user_agent_hash", "source_ip_hash", "writes", "request_object_bytes", "response_object_bytes",
        F.get(F.array(*[F.lit(x) for x in ("unverified", "low", "medium", "high")]), F.col("_rank")).alias("highest_match_level"),
        "exact_object_matches", "resource_matches", "namespace_matches",
    )


def order_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.desc(match_rank(F.col("highest_match_level"))), F.desc("exact_object_matches"), F.desc("writes"), "username", "user_agent_hash", "source_ip_hash")


def audit_writes(events: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The writes of a window."""
    return events.filter(F.col("verb").isin(*WRITE_VERBS) & window_membership(F.col("observed_at"), start, end))


def audit_head(writes: DataFrame, summary: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """One row of total and coverage; needs no growth sets."""
    head = summary.select(evidence_coverage(F.col("first_observed_at"), F.col("last_observed_at"), start, end).alias("coverage"))
    return writes.agg(F.count("*").alias("total")).crossJoin(F.broadcast(head.limit(1)))


def audit_evidence(events: DataFrame, summary: DataFrame, sets: dict[str, DataFrame], start: datetime, end: datetime, number: int = 1, size: int = 100) -> dict[str, DataFrame]:
    """Writes of the window with their match level: a page of them, all candidates, and one row of total and coverage."""
    inside = audit_writes(events, start, end)
    matched = match_growth_sets(inside, sets).withColumn("match_level", audit_match_level())
    return {"items": timeline_page(matched, number, size), "candidates": order_candidates(audit_candidates(matched)), "head": audit_head(inside, summary, start, end)}
