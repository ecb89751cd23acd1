"""Metric series, samples, curves and evidence."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException

from kvspace.operators import metrics as M
from kvspace.sources import readers

T0 = datetime(2026, 8, 3, 10)
DB, DEBUG_PUT, PUT = "etcd_mvcc_db_total_size_in_bytes", "etcd_debugging_mvcc_put_total", "etcd_mvcc_put_total"
SAMPLES = "series_hash string, metric_type string, instance string, observed_at timestamp, value double, histogram_le double"
MIB = float(1 << 20)


def series(spark, *own):
    return M.metric_series(spark.createDataFrame([(i, m, v) for i, (m, v) in enumerate(own)], "series_id bigint, metric map<string,string>, values array<array<string>>"))


def test_normalize(spark):
    own = series(spark, ({"__name__": DB, "instance": "m1"}, [["2", "20"], ["1", "10"], ["2", "25"], ["3", "NaN"]]), ({"__name__": "up"}, [["1", "1"]]))
    s = M.metrics_scan_summary(own).first()
    assert (s.total_series, s.supported_series, s.unsupported_series, s.total_samples, s.valid_samples, s.discarded_samples, s.instances, s.metric_types) == (2, 1, 1, 5, 2, 1, 1, ["db_total_bytes"])
    assert sorted((r.observed_at.second, r.value) for r in M.sample_dedup(M.raw_samples(own)).collect()) == [(1, 10.0), (2, 25.0)]


def test_alias_and_bounds(spark):
    own = series(spark, ({"__name__": DEBUG_PUT, "instance": "m"}, [["1", "1"]]), ({"__name__": PUT, "instance": "m"}, [["1", "2"]]), ({"__name__": DEBUG_PUT, "instance": "other"}, [["1", "3"]]))
    assert sorted(r.source_metric_name for r in M.stable_alias_dedup(own).collect()) == [DEBUG_PUT, PUT]
    assert M.metrics_scan_summary(own).first().unsupported_series == 0
    name = "etcd_disk_wal_fsync_duration_seconds_bucket"
    own = series(spark, *[({"__name__": name, "le": le}, [["1", "1"]]) for le in ("0.1", "+Inf", "-1", "x", "Infinity", "1e-3")], ({"__name__": name}, []))
    assert sorted(r.histogram_le for r in M.stable_alias_dedup(own).collect()) == [0.001, 0.1, float("inf")]


def test_bad_samples(spark):
    own = series(spark, ({}, []), ({"__name__": DB}, [["-1", "2"], ["1", "Inf"], ["2", "3"], ["4"]]))
    s = M.metrics_scan_summary(own).first()
    assert (s.unsupported_series, s.total_samples, s.valid_samples, s.discarded_samples) == (1, 4, 1, 3)


@pytest.mark.parametrize("text", ['{"status":"error","data":{"resultType":"matrix","result":[]}}', '{"status":"success","data":{"resultType":"vector","result":[]}}', '{"status":"success","data":{"resultType":"matrix"}}', "no json"])
def test_envelope(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    with pytest.raises(PySparkException):
        readers.read_metric_matrix(spark, str(tmp_path)).collect()


def test_matrix(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"status": "success", "data": {"resultType": "matrix", "result": [{"metric": {"__name__": DB}, "values": [[1.5, "10"], [2, "x"]]}]}}, indent=1))
    raw = readers.read_metric_matrix(spark, str(tmp_path))
    assert M.sample_dedup(M.raw_samples(M.metric_series(raw))).first().observed_at.microsecond == 500000


def minutes(spark, **own):
    """metric__instance(__le) = {minute: value} or a list from minute 0."""
    data = []
    for name, values in own.items():
        metric, instance, *le = name.split("__")
        for k, v in values.items() if isinstance(values, dict) else enumerate(values):
            data.append((name, metric, instance, T0 + timedelta(minutes=k), float(v), float(le[0].replace("_", ".")) if le else None))
    return spark.createDataFrame(data, SAMPLES)


def evidence(spark, samples, end, start=0):
    return M.metrics_evidence(samples, samples.select("series_hash").distinct(), T0 + timedelta(minutes=start), T0 + timedelta(minutes=end)).first()


def at(minute):
    return T0 + timedelta(minutes=minute)


def test_growth(spark):
    own = minutes(spark, db_total_bytes__m1=[v * MIB for v in (100, 102, 110, 120, 130, 140)], db_in_use_bytes__m1=[v * MIB for v in (90, 91, 95, 100, 105, 110)], quota_bytes__m1=[200 * MIB] * 6, put_total__m1=[0, 10, 6010, 6020, 6030, 6040], delete_total__m1=range(6))
    e = evidence(spark, own, 5)
    assert (e.coverage, e.growth_metric, e.growth_threshold_bytes, e.growth_started_at) == ("full", "db_total_bytes", 8 * MIB, at(2))
    assert (e.peak_put_rate, e.peak_put_rate_at, e.put_temporally_aligned, e.quota_peak_ratio, e.max_defrag_reclaimable_bytes) == (100.0, at(2), True, 0.7, 30 * MIB)
    assert (e.db_total_delta_bytes, e.largest_growth_from, e.largest_growth_bytes, e.wal_fsync_p99) == (40 * MIB, at(2), 10 * MIB, 0.0)


def test_gap(spark):
    gib = 1024 * MIB
    own = minutes(spark, db_total_bytes__m1={0: 2 * gib, 1: 2.03 * gib, 10: 2.04 * gib, 11: 2.05 * gib}, put_total__m1={0: 100, 1: 90, 10: 100, 11: 110})
    e = evidence(spark, own, 11)
    assert (e.coverage, e.growth_started_at) == ("partial", None) and e.peak_put_rate == pytest.approx(10 / 60)


def test_members_and_coverage(spark):
    own = minutes(spark, db_total_bytes__m1=[100, 120], db_total_bytes__m2=[90, 110])
    assert evidence(spark, own, 1).db_total_delta_bytes == 20
    assert evidence(spark, own.limit(0), 1).coverage == "unknown"
    late = evidence(spark, own, 130, 120)
    assert (late.coverage, late.growth_metric, late.growth_baseline_bytes, late.peak_put_rate) == ("none", "db_in_use_bytes", 0.0, 0.0)
    assert evidence(spark, minutes(spark, put_total__m1=[1, 2]), 1).coverage == "partial"


def test_histogram(spark):
    own = minutes(spark, wal_fsync_seconds__m1__0_1=[0, 50], wal_fsync_seconds__m1__0_5=[0, 99], wal_fsync_seconds__m1__1=[0, 100])
    found = M.histogram_quantile(own, "wal_fsync_seconds", 0.99).collect()
    assert [(r.observed_at, round(r.value, 9)) for r in found] == [(at(1), 0.5)]
    top = minutes(spark, wal_fsync_seconds__m1__1=[0, 1], wal_fsync_seconds__m1__inf=[0, 100])
    assert M.histogram_quantile(top, "wal_fsync_seconds", 0.99).first().value == 1.0
    still = minutes(spark, wal_fsync_seconds__m1__1=[5, 5], wal_fsync_seconds__m1__inf=[7, 7])
    assert M.histogram_quantile(still, "wal_fsync_seconds", 0.99).count() == 0


def test_downsample(spark):
    values = [float(i % 7) for i in range(1000)]
    values[501] = 999.0
    own = minutes(spark, db_total_bytes__m1=values).select("observed_at", "value")
    found = {r.observed_at: r.value for r in M.downsample_minmax(own).collect()}
    assert len(found) <= 600 and found[at(501)] == 999.0
    expected = {}
    for b in range(300):
        part = range(b * 1000 // 300, (b + 1) * 1000 // 300)
        expected |= {at(k): values[k] for k in (min(part, key=lambda k: (values[k], k)), max(part, key=lambda k: (values[k], -k)))}
    assert found == expected
    assert M.downsample_minmax(own.limit(5)).count() == 5


def test_predecessor_and_rates(spark):
    own = minutes(spark, put_total__m1={-1: 0, 0: 600, 1: 660, 2: 720, 3: 780, 4: 840}, db_total_bytes__m1=[v * MIB for v in (10, 20, 30, 40, 50)], quota_bytes__m1=[100 * MIB] * 5)
    e = evidence(spark, own, 4)
    assert e.growth_started_at is not None and (e.peak_put_rate, e.quota_peak_ratio) == (10.0, 0.5)
    assert [(r.series_hash, r.value) for r in M.predecessor_sample(own, T0).collect()] == [("put_total__m1", 0.0)]
    assert M.boundary_union(own, T0, at(1)).count() == 7 and M.series_count(own, T0, at(1)).first()[0] == 3
    b = M.timeline_bounds(own, at(1), at(2)).first()
    assert (b.from_at, b.to_at) == (at(-1), at(4))
    assert M.timeline_bounds(own.limit(0)).first().from_at is None


def test_median_and_runs(spark):
    rng = random.Random(3)
    for n in (1, 2, 3, 4, 9):
        steps = [rng.randrange(1, 9) for _ in range(n)]
        own = minutes(spark, db_total_bytes__m1={sum(steps[:k]): k for k in range(n + 1)}).select("observed_at", "value")
        median = sorted(steps)[(n - 1) // 2]
        assert M.median_interval(own).first().median_us == median * 60_000_000
        assert M.has_gap(own).first().has_gap == (max(steps) > 3 * median)
    own = minutes(spark, db_total_bytes__m1=[9, 9, 0, 9, 9, 9]).select("observed_at", "value")
    assert M.growth_start(own, 5).first().growth_started_at == at(3)
    assert M.curve_peak(own).first().peak_at == T0 and M.curve_delta(own).first().delta == 0.0
    assert M.curve_peak(own.selectExpr("observed_at", "-value AS value")).first().peak_value == 0.0


def test_pages(spark):
    own = minutes(spark, put_total__m1=[1, 2], put_total__m2=[3], db_total_bytes__m1=[5])
    assert [(r.metric_type, r.instance) for r in M.metrics_timeline(own, number=2, size=2).collect()] == [("put_total", "m2")]
    assert [r.value for r in M.metric_data(own, metric_type="put_total", size=2).collect()] == [1.0, 3.0]
    gauge = minutes(spark, quota_bytes__a=[0, 7, -1], quota_bytes__b=[5, 0, 0])
    assert [r.value for r in M.cluster_gauge(gauge, "quota_bytes", False).orderBy("observed_at").collect()] == [5.0, 7.0, 0.0]
    curves = M.metric_curves(own, T0, at(1)).collect()
    assert {c.metric_type for c in curves} == {"db_total_bytes", "put_total"}
