"""Log lines to events, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspace.functions.steps import computed_once
from kvspace.schemas import EVENT_TYPES

MAX_LINE = 1 << 20
MAX_DURATION_MS = 24 * 3600 * 1000
MAX_INTEGER = 1 << 62

# Ordered rules. A rule holds if the text contains one of ``any`` and, where given, one of ``also``.
_SLOW = ("slow", "took", "latency")
_TYPE_RULES = (
    ("nospace", ("database space exceeded", "space quota exceeded", "no space left", "nospace"), ()),
    ("quota_exceeded", ("quota exceeded", "quotaexceeded"), ()),
    ("compaction", ("compaction", "compacted revision", "compact revision"), ()),
    ("defrag", ("defrag",), ()),
    ("slow_fdatasync", ("fdatasync",), _SLOW),
    ("wal_fsync", ("wal",), ("fsync",)),
    ("slow_backend_commit", ("backend commit",), _SLOW),
    ("slow_apply", ("apply request",), _SLOW),
    ("leader_change", ("leader change", "became leader", "elected leader"), ()),
    ("request_timeout", ("request timed out", "deadline exceeded", "timeout"), ()),
    ("snapshot_restore", ("snapshot",), ("restor",)),
    ("snapshot_save", ("snapshot",), ("save", "saving")),
    ("lease_revoke", ("lease",), ("revoke",)),
    ("corruption_check", ("corrupt", "integrity check"), ()),
    ("large_request", ("large request", "request too large", "max request size"), ()),
    ("backend_commit", ("backend commit",), ()),
)
_ERROR = ("fatal", "panic", "corrupt", "error", "failed")
_WARN = ("warn", "exceeded", "timeout", "too long")
_SOURCES = ("mvcc", "backend", "wal", "raft", "lease", "etcdserver")
_DURATION = "(?i)(?:duration|took|latency)\\s*[=:]?\\s*([0-9]+(?:\\.[0-9]+)?)\\s*(ms|milliseconds?|s|seconds?|us|µs)"
_REVISION = "(?i)\\b(?:revision|rev)\\s*[:=]?\\s*([0-9]+)"
_DB_SIZE = "(?i)\\b(?:db[_ ]?size|database[_ ]?size|size[_ ]?bytes)\\s*[:=]?\\s*([0-9]+)"
_FIELDS = ("__REALTIME_TIMESTAMP", "PRIORITY", "LEVEL", "SYSLOG_IDENTIFIER", "_SYSTEMD_UNIT", "MESSAGE")


def _first(value: Column, over: Column, found) -> Column:
    """First element of the array ``over`` that ``found(value, element)`` accepts, else null; value is computed once.

    Rules are data that one expression walks over, so that generated code stays small however
    many there are.
    """
    return F.get(F.transform(F.array(value), lambda v: F.get(F.filter(over, lambda x: found(v, x)), F.lit(0))), F.lit(0))


def _holds(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(text, w))


def _words(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def log_event_type(message: Column) -> Column:
    rules = F.array(*[F.struct(F.lit(name).alias("name"), _words(words).alias("any"), _words(also).alias("also")) for name, words, also in _TYPE_RULES])
    rule = _first(F.lower(message), rules, lambda low, r: _holds(low, r["any"]) & ((F.size(r["also"]) == 0) | _holds(low, r["also"])))
    return F.coalesce(rule["name"], F.lit("unknown"))


def log_event_type_value(value: Column) -> Column:
    """An explicit type, or unknown."""
    clean = F.lower(F.trim(F.replace(value, F.lit("-"), F.lit("_"))))
    return F.when(clean.isin(*EVENT_TYPES), clean).otherwise("unknown")


def severity_from_value(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("0", "1", "2", "3", "error", "err", "fatal", "panic"), "ERROR").when(v.isin("4", "warn", "warning"), "WARN").when(v.isin("5", "6", "7", "info", "information", "debug", "trace"), "INFO").otherwise("UNKNOWN")


def severity_from_priority(value: Column) -> Column:
    number = F.when(value.rlike("^[+-]?[0-9]+$"), value.try_cast("int"))
    return F.when(number.between(0, 7), severity_from_value(number.cast("string"))).otherwise("UNKNOWN")


def severity_from_text(message: Column) -> Column:
    rules = F.array(*[F.struct(F.lit(name).alias("name"), _words(words).alias("any")) for name, words in (("ERROR", _ERROR), ("WARN", _WARN))])
    rule = _first(F.lower(message), rules, lambda low, r: _holds(low, r["any"]))
    return F.coalesce(rule["name"], F.when(message != "", "INFO"), F.lit("UNKNOWN"))


def source_from_text(message: Column) -> Column:
    return F.coalesce(_first(F.lower(message), _words(_SOURCES), F.contains), F.lit("unknown"))


def parse_log_time(*texts: Column) -> Column:
    """The first of the texts that is RFC 3339, one of the two forms with a space, or a count of microseconds."""
    day, clock = "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\\.[0-9]+)?"

    def parsed(v: Column) -> Column:
        zoned = v.rlike(f"^{day}[T ]{clock}(?:Z|[+-][0-9]{{2}}:[0-9]{{2}})$")
        bare = v.rlike(f"^{day} {clock}$")
        exact = F.concat(F.regexp_replace(v, "(\\.[0-9]{6})[0-9]+", "$1"), F.when(bare, "Z").otherwise(""))
        return F.when(zoned | bare, F.try_to_timestamp(exact)).when(v.rlike("^[0-9]+$"), F.timestamp_micros(v.try_cast("bigint")))

    clean = F.transform(F.array(*texts), lambda v: F.trim(F.trim(v, F.lit('"'))))
    return F.get(F.filter(F.transform(clean, parsed), lambda x: x.isNotNull()), F.lit(0))


def duration_ms(text: Column) -> Column:
    """Milliseconds of the text's first duration."""
    parts = F.struct(F.regexp_extract(text, _DURATION, 1).try_cast("double").alias("value"), F.lower(F.regexp_extract(text, _DURATION, 2)).alias("unit"))
    scaled = F.transform(F.array(parts), lambda p: F.floor(p["value"] * F.when(p["unit"].isin("s", "second", "seconds"), 1000.0).when(p["unit"].isin("us", "µs"), 0.001).otherwise(1.0)))
    return F.get(F.filter(scaled, lambda x: (x >= 0) & (x <= MAX_DURATION_MS)), F.lit(0))


def _integer(text: Column, most: int = MAX_INTEGER) -> Column:
    number = text.try_cast("bigint")
    return F.when((number >= 0) & (number <= most), number)


def revision_from_text(message: Column) -> Column:
    return _integer(F.regexp_extract(message, _REVISION, 1))


def db_size_from_text(message: Column) -> Column:
    return _integer(F.regexp_extract(message, _DB_SIZE, 1))


def _json(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def first_safe_int(fields: Column, most: int, *names: str) -> Column:
    """First of the named values (JSON texts by name) that is an integer in range."""
    bare = F.transform(_words(names), lambda n: F.trim(F.trim(F.try_element_at(fields, n), F.lit('"'))))
    found = F.transform(F.filter(bare, lambda v: v.rlike("^[+-]?[0-9]+$")), lambda v: v.try_cast("bigint"))
    return F.get(F.filter(found, lambda v: (v >= 0) & (v <= most)), F.lit(0))


def message_fingerprint(message: Column) -> Column:
    return F.sha2(message, 256)


def _field(line: Column, name: str) -> Column:
    """Value of a journal field: up to the next field of the list; without quotes around it, empty if there is none."""
    others = "|".join(x for x in _FIELDS if x != name)
    value = F.trim(F.regexp_extract(line, f"(?s){name}=(.*?)(?: (?:{others})=|\\z)", 1))
    return F.regexp_replace(value, '(?s)^"+(.*?)"+$', "$1")


def log_normalize(lines: DataFrame, text: str, column: str = "e") -> DataFrame:
    """lines with a struct ``column``: the event of each line, null for a null line.

    A line is empty, JSON, journal fields, or text with a time before it; a container prefix
    is taken off first, and then JSON goes before journal fields. A JSON line whose message
    has no known type is read once more as text, as a whole; a container line that is no
    JSON loses the container's time.

    The kind of line is found first, in steps that Spark keeps apart, and the event's
    attributes are then computed once, from the one message that the line has.
    """
    prefix = "(?s)^[^ ]* (?:stdout|stderr) [^ ]* "
    stamped = "^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.+Z-]+)\\s+"
    c = F.col
    named = lambda *names: F.coalesce(*[F.trim(_json(c("_j"), n)) for n in names], F.lit(""))
    out = computed_once(lines, {"_line": F.trim(F.regexp_replace(c(text), "\\r$", ""))})
    out = computed_once(out, {"_outer": F.when(c("_line").rlike(prefix), parse_log_time(F.substring_index("_line", " ", 1)))})
    out = computed_once(out, {"_body": F.when(c("_outer").isNotNull(), F.trim(F.regexp_replace("_line", prefix, ""))).otherwise(c("_line"))})
    out = computed_once(out, {"_brace": c("_body").startswith("{"), "_own": F.when(c("_body").contains("MESSAGE="), _field(c("_body"), "MESSAGE")).otherwise("")})
    out = computed_once(out, {"_j": F.when(c("_brace"), F.from_json("_body", "map<string,string>"))})
    out = computed_once(out, {
        "_broken": F.when(c("_brace"), F.try_parse_json("_body").isNull()),
        "_message": named("msg", "message", "log"),
        "_explicit": log_event_type_value(named("event_type", "eventType", "type")),
    })
    by_json = F.when(~c("_brace"), F.lit(None)).when(c("_broken"), "json_error").when(c("_message") == "", "json_missing_message").when((c("_explicit") != "unknown") | (log_event_type(c("_message")) != "unknown"), "json")
    by_journal = F.when(c("_own") != "", "journal")
    route = F.when(c("_line") == "", "empty").when(c("_outer").isNotNull(), F.coalesce(by_json, by_journal, F.lit("text"))).otherwise(F.coalesce(by_journal, by_json, F.lit("text")))
    out = computed_once(out, {"_route": route, "_stamp": F.regexp_extract("_body", stamped, 1), "_rest": F.trim(F.regexp_replace("_body", stamped, ""))})
    journal, json = c("_route") == "journal", c("_route") == "json"
    whole = F.when(c("_rest") == "", c("_body")).otherwise(c("_rest"))
    time_text = F.when(journal, _field(c("_body"), "__REALTIME_TIMESTAMP")).when(c("_route") == "text", c("_stamp"))
    json_time = F.coalesce(parse_log_time(*[_json(c("_j"), n) for n in ("ts", "timestamp", "time", "observed_at", "observedAt")]), "_outer")
    severity = F.when(json, severity_from_value(named("level", "severity", "priority"))).when(journal, severity_from_priority(_field(c("_body"), "PRIORITY")))
    unit = F.coalesce(F.nullif(_field(c("_body"), "SYSLOG_IDENTIFIER"), F.lit("")), _field(c("_body"), "_SYSTEMD_UNIT"))
    out = computed_once(out, {
        "_text": F.when(json, c("_message")).when(journal, c("_own")).when(c("_route") == "text", whole).when(c("_route") == "empty", c("_line")).otherwise(c("_body")),
        "_at": F.when(json, json_time).otherwise(parse_log_time(time_text)),
        "_severity": severity,
        "_level": F.when(journal, severity_from_value(_field(c("_body"), "LEVEL"))),
        "_source": F.when(json, named("caller", "component", "source", "logger", "name")).when(journal, unit),
        "_duration": F.when(json, first_safe_int(c("_j"), MAX_DURATION_MS, "duration_ms", "durationMs", "duration", "took_ms", "tookMs")),
        "_revision": F.when(json, first_safe_int(c("_j"), MAX_INTEGER, "revision", "rev", "revision_number", "revisionNumber")),
        "_size": F.when(json, first_safe_int(c("_j"), MAX_INTEGER, "db_size_bytes", "dbSizeBytes", "db_size", "database_size")),
    })
    out = computed_once(out, {"_type": F.when(json & (c("_explicit") != "unknown"), c("_explicit")).otherwise(log_event_type(c("_text")))})
    good = json | journal | ((c("_route") == "text") & (c("_type") != "unknown"))
    out = computed_once(out, {"_good": good})
    known = lambda x: F.when(c("_good"), x)
    sure = F.when(c("_severity") != "UNKNOWN", c("_severity")).when(c("_level") != "UNKNOWN", c("_level"))
    event = F.struct(
        known(c("_at")).alias("observed_at"),
        F.when(c("_good"), c("_type")).otherwise("unknown").alias("event_type"),
        F.when(c("_good"), F.coalesce(sure, severity_from_text(c("_text")))).otherwise("UNKNOWN").alias("severity"),
        F.when(c("_good"), F.coalesce(F.when(c("_source") != "", c("_source")), source_from_text(c("_text")))).otherwise("unknown").alias("source"),
        known(F.coalesce("_duration", duration_ms(c("_text")))).alias("duration_ms"),
        known(F.coalesce("_revision", revision_from_text(c("_text")))).alias("revision"),
        known(F.coalesce("_size", db_size_from_text(c("_text")))).alias("db_size_bytes"),
        F.when(c("_good"), F.when(c("_at").isNull(), "unknown_time").otherwise("recognized")).when(c("_route") == "text", "unknown").otherwise(c("_route")).alias("parse_status"),
        message_fingerprint(c("_text")).alias("message_fingerprint"),
        c("_good").alias("recognized"),
        c("_route").isin("json_error", "json_missing_message").alias("parse_error"),
    )
    return computed_once(out, {column: F.when(c(text).isNotNull(), event)}).select(*lines.columns, column)
