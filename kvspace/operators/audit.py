"""Audit events: normalizing, one row for each request, counts, timelines."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvspace import schemas
from kvspace.functions.requests import audit_normalize, is_write_verb
from kvspace.functions.steps import computed_once
from kvspace.operators.logs import filter_timeline, grouped_counts, timeline_page

DIMENSIONS = [("username", "username"), ("user_agent", "user_agent"), ("network", "source_network"), ("verb", "verb"), ("resource", "_resource"), ("namespace", "namespace")]


#: What tells which event of an id is the one to keep, and whether it is a write of some window.
HEAD = ("audit_id_hash", "observed_at", "stage_rank", "verb")


def audit_rows(lines: DataFrame, task_id: str, only: tuple[str, ...] | None = None) -> DataFrame:
    """Every line of (line_number, line) with its event, null where the line is no JSON object of the schema.

    With ``only``, events have these attributes alone, and the line stays.
    """
    parsed = F.from_json("line", schemas.AUDIT_JSON + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    read = computed_once(lines.select("line_number", "line"), {"_j": parsed})
    good = F.col("_j").isNotNull() & F.col("_j._bad").isNull() & F.trim("line").startswith("{")
    out = computed_once(read.withColumn("_ok", good), {"e": F.when(F.col("_ok"), audit_normalize(F.col("_j"), F.col("line"), only))})
    return out.select(F.lit(task_id).alias("task_id"), "line_number", *(["line"] if only else []), "e")


def audit_events(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("e").isNotNull()).select(*[c for c in rows.columns if c != "e"], "e.*")


def audit_dedup(events: DataFrame) -> DataFrame:
    """One row for each audit id: the highest stage, of equal stages the first line.

    A grouped maximum, so a busy id is reduced before the shuffle.
    """
    rest = [c for c in events.columns if c not in ("task_id", "audit_id_hash")]
    best = events.groupBy("task_id", "audit_id_hash").agg(F.max_by(F.struct(*rest), F.struct("stage_rank", -F.col("line_number"))).alias("r"))
    return best.select("task_id", "audit_id_hash", "r.*").select(*events.columns)


def audit_window(lines: DataFrame, task_id: str, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``wanted`` keeps of the events with one row for each request; it may use the attributes of HEAD.

    These alone decide which event of an id is kept, so only lines that are wanted are normalized in full.
    """
    kept = wanted(audit_dedup(audit_events(audit_rows(lines, task_id, HEAD)))).select("line_number", "line")
    return audit_events(audit_rows(kept, task_id))


def audit_scan_summary(rows: DataFrame) -> DataFrame:
    valid = F.col("e").isNotNull()
    return rows.agg(
        F.count("*").alias("total_lines"),
        F.count_if(valid).alias("valid_events"),
        F.count_if(valid & is_write_verb(F.col("e.verb"))).alias("write_events"),
        F.count_if(~valid).alias("unknown_lines"),
        F.count_if(~valid).alias("parse_errors"),
        (F.count_if(valid) - F.count_distinct("e.audit_id_hash")).alias("duplicate_events"),
        F.min("e.observed_at").alias("first_observed_at"),
        F.max("e.observed_at").alias("last_observed_at"),
    )


def audit_counts(events: DataFrame) -> DataFrame:
    """(dimension, value, count) by user, agent, network, verb, resource and namespace in one pass."""
    resource = F.when(F.col("api_group") == "", F.col("resource")).otherwise(F.concat_ws("/", "api_group", "resource"))
    return grouped_counts(events.withColumn("_resource", resource), DIMENSIONS)


def audit_timeline(events: DataFrame, start: datetime | None = None, end: datetime | None = None, number: int = 1, size: int = 100, **equal: str | None) -> DataFrame:
    """``equal`` may name verb, username, user_agent, source_network, api_group, resource, namespace, object_key_hash."""
    return timeline_page(filter_timeline(events, start, end, **equal), number, size)
