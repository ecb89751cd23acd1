"""Windows over ranges of time give what windows over whole groups give."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kvspace.operators import metrics as M
from kvspace.operators import segments as S
from tests.conftest import rows

START = datetime(2026, 8, 3)


@pytest.fixture(scope="module")
def samples(spark):
    """Series of uneven steps, resets, gaps and lengths; one with a single sample."""
    rng = random.Random(4)
    made = []
    for kind, le in (("put_total", None), ("db_total_bytes", None), ("db_in_use_bytes", None), ("quota_bytes", None), ("delete_total", None), ("backend_commit_seconds", 1.0), ("backend_commit_seconds", float("inf")), ("wal_fsync_seconds", 2.0)):
        for member in range(3):
            at, value = START, 1e8
            for _ in range(rng.choice([1, 40, 200])):
                at += timedelta(seconds=rng.choice([10, 10, 10, 11, 30, 500]), microseconds=rng.choice([0, 0, 7]))
                value = rng.choice([value + rng.randint(0, 10**7)] * 5 + [value / 2, value])
                made.append((f"{kind}{le}{member}", kind, f"m{member}", le, at, float(value)))
    return spark.createDataFrame(made, "series_hash string, metric_type string, instance string, histogram_le double, observed_at timestamp, value double").cache()


CUTS = ([], [3], [1, 60, 61, 62, 900, 4000], list(range(0, 20_000, 97)))


def micros(seconds):
    from datetime import timezone

    return [int((START.replace(tzinfo=timezone.utc) + timedelta(seconds=s)).timestamp() * 1_000_000) for s in seconds]


@pytest.mark.parametrize("seconds", CUTS[1:])
def test_curves_over_ranges(samples, seconds):
    cuts = micros(seconds)
    by = ("metric_type",)
    curve = samples.groupBy(*by, "observed_at").agg(F.max("value").alias("value"))
    limits = curve.groupBy(*by).agg((F.min("value") * 1.3).alias("threshold"))
    end = START + timedelta(hours=9)
    for made in (
        lambda c: M.median_interval(curve, by, c),
        lambda c: M.has_gap(curve, by, c),
        lambda c: M.growth_start(curve, limits, by, c),
        lambda c: M.largest_growth(curve, by, c),
        lambda c: M.downsample_minmax(curve, 12, by, c),
        lambda c: M.counter_rate(samples, "put_total", START + timedelta(seconds=100), end, ("instance",), c),
        lambda c: M.histogram_merge(samples, "backend_commit_seconds", cuts=c),
    ):
        assert rows(made(cuts)) == rows(made([]))


def test_previous_and_running_of_null_groups(spark):
    own = spark.createDataFrame([(k, START + timedelta(seconds=s), float(s)) for k in ("a", None) for s in range(20)] + [("b", None, 1.0)], "k string, at timestamp, v double")
    for cuts in (micros([5, 11]), []):
        out = {(r.k, r.v): (r.p and r.p.v, r.total) for r in S.running(S.previous(own, ("k",), "at", ["v"], cuts, "p"), ("k",), "at", F.col("v"), cuts, "total").collect() if r.at}
        assert out == {(k, float(s)): (float(s - 1) if s else None, s * (s + 1) / 2) for k in ("a", None) for s in range(20)}


def test_time_cuts(samples):
    assert S.time_cuts(samples) == []
    cuts = S.time_cuts(samples, rows=50)
    sizes = [r["count"] for r in S.with_range(samples, "observed_at", cuts, "part").groupBy("part").count().collect()]
    assert len(cuts) > 5 and max(sizes) <= 120 and sum(sizes) == samples.count()


def test_median_is_the_disc_percentile(samples):
    by = ("series_hash",)
    gaps = samples.select(*by, (F.unix_micros("observed_at") - F.lag(F.unix_micros("observed_at")).over(Window.partitionBy(*by).orderBy("observed_at"))).alias("gap"))
    want = gaps.groupBy(*by).agg(F.coalesce(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN gap > 0 THEN gap END)"), F.lit(0)).cast("bigint").alias("median_us"))
    assert rows(M.median_interval(samples, by)) == rows(want)
    assert rows(M.median_interval(samples.limit(0))) == [(0,)] and rows(M.has_gap(samples.limit(0))) == [(True,)]


@pytest.mark.parametrize("most", [10_000, 2])
def test_predecessors_of_many_windows(spark, samples, monkeypatch, most):
    monkeypatch.setattr(M, "MAX_STARTS", most)
    own = [(r.series_hash, r.observed_at, r.value) for r in samples.collect()]
    starts = [START, START + timedelta(seconds=100), own[5][1], own[70][1] + timedelta(microseconds=1), START + timedelta(seconds=900), START + timedelta(days=9), None]
    windows = spark.createDataFrame([(f"w{k}", t) for k, t in enumerate(starts)] + [("twin", starts[1])], "window_id string, from_at timestamp")
    found = {(r.window_id, r.series_hash): (r.observed_at, r.value) for r in M.predecessors(samples, windows).collect()}
    want = {}
    for w, t in [*((f"w{k}", t) for k, t in enumerate(starts)), ("twin", starts[1])]:
        for h, at, v in sorted(own, key=lambda x: x[1]):
            if t is not None and at < t:
                want[w, h] = (at, v)
    assert found == want
    assert M.predecessors(samples, windows.limit(0)).count() == 0


def test_evidence_reads_the_samples_once(spark, samples, tmp_path):
    samples.write.parquet(str(tmp_path / "samples"))
    own = spark.read.parquet(str(tmp_path / "samples"))
    start, end = START + timedelta(seconds=100), START + timedelta(seconds=3000)
    out = M.metrics_evidence(own, own.limit(0), start, end)
    assert not [f for f in out.inputFiles() if "samples" in f]
    r = out.first()
    inside, both = M.samples_in_window(own, start, end), M.boundary_union(own, start, end)
    assert both.count() == inside.count() + M.predecessor_sample(own, start).count()
    peak = lambda curve: tuple(M.curve_peak(curve).first())
    assert (r.peak_put_rate_at, r.peak_put_rate) == peak(M.counter_rate(both, "put_total", start, end))
    assert (r.peak_delete_rate_at, r.peak_delete_rate) == peak(M.counter_rate(both, "delete_total", start, end))
    assert (r.backend_commit_p99_at, r.backend_commit_p99) == peak(M.histogram_quantile(inside, "backend_commit_seconds", 0.99))
    assert r.max_defrag_reclaimable_bytes == M.reclaimable_max(inside).first()[0]
    total = M.cluster_gauge(inside, "db_total_bytes")
    assert r.quota_peak_ratio == M.quota_peak_ratio(total, M.cluster_gauge(inside, "quota_bytes", maximum=False)).first()[0]
    assert r.db_total_delta_bytes == M.curve_delta(total).first()[0]
    grown = M.largest_growth(total).first()
    assert (r.largest_growth_from, r.largest_growth_to, r.largest_growth_bytes) == tuple(grown)
    assert r.coverage == M.metrics_coverage(total, own, own.limit(0), start, end).first()[0]
    cells, _ = M.window_cells(own, start, end)
    assert rows(M.cell_curve(cells, "quota_bytes")) == rows(M.cluster_gauge(inside, "quota_bytes", maximum=False))
