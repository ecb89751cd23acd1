"""Log lines: formats, types, numbers, windows, the stream."""

from __future__ import annotations

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kvspace.functions import logtext as L
from kvspace.operators import logs
from kvspace.sources import readers

T = datetime
FORMATS = [
    ('{"ts":"2025-03-04T05:06:07.089Z","level":"warning","caller":"backend","msg":"backend: NOSPACE alarm raised for member","rev":"9001"}', "nospace", {"severity": "WARN", "source": "backend", "revision": 9001, "observed_at": T(2025, 3, 4, 5, 6, 7, 89000)}),
    ("2025-03-04T05:07:00+01:00 mvcc: scheduled compaction has ended at rev=77", "compaction", {"revision": 77, "source": "mvcc", "severity": "INFO", "observed_at": T(2025, 3, 4, 4, 7)}),
    ("2025-03-04T05:08:00Z member defrag ends, duration: 12.9 ms", "defrag", {"duration_ms": 12}),
    ("2025-03-04T05:09:00Z raft: node 7 became leader in term 3", "leader_change", {"observed_at": T(2025, 3, 4, 5, 9), "source": "raft"}),
    ("2025-03-04T05:10:00Z slow apply request, expected 100ms, latency=2s", "slow_apply", {"duration_ms": 2000}),
    ('2025-03-04T05:11:00.25Z stderr P {"priority":"debug","component":"lease","message":"lease 5 revoked"}', "lease_revoke", {"observed_at": T(2025, 3, 4, 5, 11, 0, 250000), "source": "lease", "severity": "INFO"}),
    ("__REALTIME_TIMESTAMP=1741065120000000 PRIORITY=4 SYSLOG_IDENTIFIER=kv MESSAGE=request too large: database size 4096", "large_request", {"severity": "WARN", "source": "kv", "observed_at": T(2025, 3, 4, 5, 12), "db_size_bytes": 4096}),
    ('MESSAGE="quoted words" _SYSTEMD_UNIT=unit LEVEL=warn', "unknown", {"source": "unit", "severity": "WARN", "parse_status": "unknown_time"}),
    ('{"msg":"x","event_type":"LEASE-revoke","ts":1700000000000000,"took_ms":"7"}', "lease_revoke", {"observed_at": T(2023, 11, 14, 22, 13, 20), "duration_ms": 7}),
    ("2026-08-03 10:07:00.5 wal: fsync done in latency 2s db size 77", "wal_fsync", {"observed_at": T(2026, 8, 3, 10, 7, 0, 500000), "duration_ms": 2000, "db_size_bytes": 77}),
    ("10:05 stdout F snapshot saved", "snapshot_save", {"parse_status": "unknown_time"}),
    ("2026-08-03T10:05:00Z stderr F snapshot restored", "snapshot_restore", {"observed_at": None}),
]
UNKNOWN = [("nothing known", "unknown", False), ("", "empty", False), ("{bad", "json_error", True), ('{"a":1}', "json_missing_message", True), ('{"msg":"hello","ts":"2026-08-03T10:00:00Z"}', "unknown", False)]


def events(spark, lines):
    return logs.log_events(spark.createDataFrame([(i, x) for i, x in enumerate(lines, 1)], "line_number bigint, line string"), "t")


def test_formats(spark):
    found = events(spark, [x for x, *_ in FORMATS]).orderBy("line_number").collect()
    for r, (line, kind, more) in zip(found, FORMATS, strict=True):
        assert r.recognized and not r.parse_error and r.event_type == kind, line
        for k, v in more.items():
            assert r[k] == v, (line, k)


def test_unknown_lines(spark):
    found = events(spark, [x for x, *_ in UNKNOWN] + [None]).orderBy("line_number").collect()
    for r, (line, status, error) in zip(found, UNKNOWN, strict=False):
        assert (r.event_type, r.severity, r.parse_status, r.parse_error, r.recognized) == ("unknown", "UNKNOWN", status, error, False)
        assert r.message_fingerprint == hashlib.sha256(line.encode()).hexdigest() and r.observed_at is None
    assert found[-1].parse_error
    s = logs.log_scan_summary(events(spark, [FORMATS[1][0], "odd", "{bad"])).first()
    assert (s.total_lines, s.recognized_events, s.unknown_lines, s.parse_errors, s.first_observed_at) == (3, 1, 2, 1, T(2025, 3, 4, 4, 7))
    assert not any("quoted words" in str(v) for r in events(spark, [FORMATS[7][0]]).collect() for v in r)


def test_numbers_out_of_range(spark):
    cases = [("took=86400001ms", None), ("took=86400s", 86_400_000), ("latency: 1.5 ms", 1), ("took 999us", 0), ("took -5ms", None), ("duration=3 seconds", 3000)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    assert [r.d for r in df.select("i", L.duration_ms(F.col("x")).alias("d")).orderBy("i").collect()] == [d for _, d in cases]
    big = spark.createDataFrame([("revision 99999999999999999999",), ("rev: 4611686018427387904",), ("revision 4611686018427387905",)], "x string")
    assert [r[0] for r in big.select(L.revision_from_text(F.col("x"))).collect()] == [None, 1 << 62, None]


def test_priorities(spark):
    df = spark.createDataFrame([("3",), ("4",), ("7",), ("8",), ("",), ("x",), ("-1",)], "x string")
    assert [r[0] for r in df.select(L.severity_from_priority(F.col("x"))).collect()] == ["ERROR", "WARN", "INFO", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


def test_windows(spark):
    lines = [f"2026-08-03T10:0{i}:00Z {m}" for i, m in enumerate(["nospace", "compaction", "nospace", "nospace", "defrag"])] + ["odd"]
    own = events(spark, lines)
    start, end = T(2026, 8, 3, 10), T(2026, 8, 3, 10, 3)
    inside = own.filter(logs.window_membership(F.col("observed_at"), start, end))
    assert inside.count() == 3
    counts = {(r.dimension, r.value): r["count"] for r in logs.log_counts(inside).collect()}
    assert counts["event_type", "nospace"] == 2 and counts["event_type", "compaction"] == 1
    assert [r.line_number for r in logs.timeline_page(inside).collect()] == [4, 3, 2]
    assert [r.line_number for r in logs.log_timeline(own, start, end, event_type="nospace").collect()] == [4, 3, 1]
    assert [r.line_number for r in logs.log_timeline(own, size=2, number=3).collect()] == [1, 6]
    many = spark.createDataFrame([("a", start, end), ("b", T(2026, 8, 2, 23), T(2026, 8, 4, 1)), ("c", end, end)], "window_id string, from_at timestamp, to_at timestamp")
    for few in (1000, 0):  # broadcast, and dealt to parts
        assert {r.window_id: r["count"] for r in logs.windows_join(own, many, few).groupBy("window_id").count().collect()} == {"a": 3, "b": 5}
    with pytest.raises(ValueError):
        logs.log_timeline(own, size=0)


def test_line_reader(spark, tmp_path):
    import gzip

    (tmp_path / "a.log").write_text("one\n" + "x" * (L.MAX_LINE + 1) + "\nthree\n")
    (tmp_path / "b.log.gz").write_bytes(gzip.compress(b"first\nsecond"))
    found = {(r.file.rsplit("/", 1)[1], r.line_number): r for r in readers.read_log_lines(spark, str(tmp_path)).collect()}
    assert sorted(found) == [("a.log", 1), ("a.log", 2), ("a.log", 3), ("b.log.gz", 1), ("b.log.gz", 2)]
    assert found["a.log", 2].overlong and found["a.log", 2].line is None and found["a.log", 3].line == "three"
    own = logs.log_events(readers.read_log_lines(spark, str(tmp_path)).select("line_number", "line", "overlong"), "t")
    assert own.filter("parse_error").count() == 1


def test_stream(spark, tmp_path):
    from kvspace.streaming.streams import log_events_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.log").write_text("\n".join(x for x, *_ in FORMATS))
    stream = log_events_stream(spark.readStream.text(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("log_stream").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.event_type for r in spark.table("log_stream").collect()) == sorted(k for _, k, _ in FORMATS)
