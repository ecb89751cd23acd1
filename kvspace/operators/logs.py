"""Log events: normalizing, counts, timelines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspace.functions.logtext import log_normalize, message_fingerprint
from kvspace.operators.paging import MAX_PAGE
from kvspace.operators.segments import unused

#: Window hours up to which they are broadcast; with more, parts that the events of an hour are dealt to.
BROADCAST_ROWS, PARTS = 200_000, 32
_STORED = ("observed_at", "event_type", "severity", "source", "duration_ms", "revision", "db_size_bytes", "parse_status", "message_fingerprint")


def log_events(lines: DataFrame, task_id: str) -> DataFrame:
    """Events of (line_number, line, overlong): no text of a line stays. Overlong lines and broken UTF-8 are errors."""
    bad = F.coalesce(F.col("overlong"), F.lit(False)) if "overlong" in lines.columns else F.lit(False)
    bad = bad | F.col("line").isNull() | ~F.is_valid_utf8("line")
    named = log_normalize(lines.select("line_number", F.when(~bad, F.col("line")).alias("_in")), "_in")
    fill = {"event_type": "unknown", "severity": "UNKNOWN", "source": "unknown", "parse_status": "line_error"}
    columns = [F.coalesce(F.col(f"e.{c}"), F.lit(fill[c])).alias(c) if c in fill else F.col(f"e.{c}").alias(c) for c in _STORED]
    return named.select(F.lit(task_id).alias("task_id"), "line_number", *columns, F.coalesce("e.recognized", F.lit(False)).alias("recognized"), F.coalesce("e.parse_error", F.lit(True)).alias("parse_error"))


def log_scan_summary(events: DataFrame) -> DataFrame:
    """One row: lines, recognized, unknown, errors, first and last time of recognized events."""
    known = F.when(F.col("recognized"), F.col("observed_at"))
    return events.agg(
        F.count("*").alias("total_lines"),
        F.count_if("recognized").alias("recognized_events"),
        F.count_if(~F.col("recognized")).alias("unknown_lines"),
        F.count_if("parse_error").alias("parse_errors"),
        F.min(known).alias("first_observed_at"),
        F.max(known).alias("last_observed_at"),
    )


def window_membership(at: Column, start: datetime, end: datetime, exclusive: bool = True) -> Column:
    """Whether a time lies in (start, end], or in [start, end]."""
    lower = at > F.lit(start) if exclusive else at >= F.lit(start)
    return F.coalesce(lower & (at <= F.lit(end)), F.lit(False))


def windows_join(events: DataFrame, windows: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Events of each of many windows (window_id, from_at, to_at], both bounds known.

    Windows are cut into the hours they touch, so events meet their windows by an equal hour
    and not by a product of the two sides. The hours are counted: few are broadcast, and with
    many the events of an hour are dealt to parts that each have its windows.
    """
    each = F.sequence(F.date_trunc("hour", "from_at"), F.date_trunc("hour", "to_at"), F.expr("INTERVAL 1 HOUR"))
    hour, part, start, end = unused(events, "_hour", "_part", "_start", "_end")
    hours = windows.filter("from_at <= to_at").select("window_id", F.col("from_at").alias(start), F.col("to_at").alias(end), F.explode(each).alias(hour))
    timed, on = events.withColumn(hour, F.date_trunc("hour", "observed_at")), [hour]
    if hours.limit(broadcast_rows + 1).count() <= broadcast_rows:
        hours = F.broadcast(hours)
    else:
        timed, on = timed.withColumn(part, F.pmod(F.xxhash64("observed_at", "line_number"), F.lit(PARTS))), [hour, part]
        hours = hours.withColumn(part, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    return timed.join(hours, on).filter((F.col("observed_at") > F.col(start)) & (F.col("observed_at") <= F.col(end))).drop(*on, start, end)


def log_counts(events: DataFrame) -> DataFrame:
    """(dimension, value, count) by type, severity and source in one pass, the most frequent first."""
    named = [("event_type", "event_type"), ("severity", "severity"), ("source", "source")]
    return grouped_counts(events, named)


def grouped_counts(events: DataFrame, dimensions: list[tuple[str, str]]) -> DataFrame:
    """Counts by each dimension alone, the most frequent first.

    Events are counted by all dimensions at once, which map tasks combine, and only these counts are
    grouped by each dimension alone: grouping sets multiply the few rows, not the events.
    """
    names = [n for n, _ in dimensions]
    together = events.groupBy(*[F.col(c).alias(n) for n, c in dimensions]).agg(F.count("*").alias("n"))
    sets = together.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(F.sum("n").alias("count"), F.grouping_id(*names).alias("id"))
    # of a grouping id's bits, the first dimension's is the highest, and is unset where it is grouped by
    ids = {(1 << len(names)) - 1 - (1 << (len(names) - 1 - k)): n for k, n in enumerate(names)}
    name = value = F.lit(None).cast("string")
    for k, n in ids.items():
        name, value = F.when(F.col("id") == k, F.lit(n)).otherwise(name), F.when(F.col("id") == k, F.col(n)).otherwise(value)
    return sets.select(name.alias("dimension"), value.alias("value"), "count").orderBy("dimension", F.desc("count"), "value")


def filter_timeline(events: DataFrame, start: datetime | None = None, end: datetime | None = None, exclusive: bool = False, **equal: str | None) -> DataFrame:
    """Events of a span (both ends in, unless the start is exclusive) with the given values; without a span, also those of unknown time."""
    out = events
    if start is not None:
        out = out.filter(F.col("observed_at") > F.lit(start) if exclusive else F.col("observed_at") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("observed_at") <= F.lit(end))
    for column, value in equal.items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


def timeline_page(events: DataFrame, number: int = 1, size: int = 100) -> DataFrame:
    """Newest first, unknown times last, then the later line."""
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page must be at least 1 and its size between 1 and {MAX_PAGE}")
    ordered = events.orderBy(F.desc_nulls_last("observed_at"), F.desc("line_number"))
    return (ordered.offset((number - 1) * size) if number > 1 else ordered).limit(size)


def log_timeline(events: DataFrame, start: datetime | None = None, end: datetime | None = None, event_type: str | None = None, severity: str | None = None, source: str | None = None, number: int = 1, size: int = 100) -> DataFrame:
    return timeline_page(filter_timeline(events, start, end, event_type=event_type, severity=severity, source=source), number, size)


__all__ = ["filter_timeline", "grouped_counts", "log_counts", "log_events", "log_scan_summary", "log_timeline", "message_fingerprint", "timeline_page", "window_membership", "windows_join"]
