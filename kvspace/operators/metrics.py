"""Metric series and samples: normalizing, curves, rates, quantiles, and the evidence of a window.

A curve has one row for each instant (observed_at, value). Curves are computed for any
number of groups at once: ``by`` names columns that tell curves apart. Where the order of rows
matters, windows run within ranges of time (``segments``), so that no task holds a curve or a
series; ``cuts`` are the ranges' bounds, measured from the rows unless they are given. Times
are compared in microseconds.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvspace.functions.series import HISTOGRAMS, histogram_bound, normalize_metric, series_identity
from kvspace.operators.logs import window_membership
from kvspace.operators.paging import MAX_PAGE
from kvspace.operators.segments import Cuts, previous, running, time_cuts, unused, with_range
from kvspace.schemas import METRIC_TYPES
from kvspace.session import stored

#: Counters whose rates are curves.
RATES = ("put_total", "delete_total")
#: Starts of windows that are looked up at a time.
MAX_STARTS = 10_000
LEAST_GROWTH = float(8 << 20)
#: Series up to which they are broadcast to their samples.
BROADCAST_SERIES = 5_000
_US = 1_000_000


def metric_series(raw: DataFrame) -> DataFrame:
    """Series (series_id, metric, values) with type, identity, labels and ``kept``.

    Not kept: unsupported names, histogram series without a good bound, and a series under a
    debugging name whose twin under the stable name is there (``aliased``).
    """
    named = normalize_metric(raw.withColumn("source_metric_name", F.coalesce(F.try_element_at("metric", F.lit("__name__")), F.lit(""))), "source_metric_name")
    label = lambda n: F.coalesce(F.try_element_at("metric", F.lit(n)), F.lit(""))
    bound = histogram_bound(label("le"))
    is_histogram = F.col("metric_type").isin(*HISTOGRAMS)
    known = named.withColumns({
        "series_hash": F.when(F.col("metric_type").isNotNull(), series_identity(F.col("metric_type"), F.col("metric"))),
        "instance": label("instance"), "job": label("job"), "member_id": label("member_id"),
        "histogram_le": F.when(is_histogram, bound),
    })
    # one grouped aggregate instead of a window, so that a busy identity is reduced before it is shuffled
    twins = known.filter("stable").select("series_hash").distinct().withColumn("_twin", F.lit(True))
    joined = known.join(twins, "series_hash", "left")
    aliased = F.coalesce(~F.col("stable") & F.col("_twin"), F.lit(False))
    supported = F.col("metric_type").isNotNull() & ~(F.coalesce(is_histogram, F.lit(False)) & bound.isNull())
    return joined.withColumns({"aliased": aliased, "kept": supported & ~aliased}).drop("_twin")


def stable_alias_dedup(series: DataFrame) -> DataFrame:
    return series.filter("kept").select("series_hash", "metric_type", "source_metric_name", "instance", "job", "member_id", "histogram_le", "values")


def raw_samples(series: DataFrame) -> DataFrame:
    """Every pair of every kept series with ``valid``, its instant and value."""
    pair = F.col("pair")
    number = lambda c: F.when(c.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))
    spread = series.filter("kept").select("series_hash", "metric_type", "instance", F.posexplode("values").alias("pos", "pair"))
    at, value = number(F.get(pair, F.lit(0))), number(F.get(pair, F.lit(1)))
    valid = (F.size(pair) == 2) & (at >= 0) & (at < 9e12) & (F.abs(value) < float("inf"))
    return spread.select("series_hash", "metric_type", "instance", "pos", F.coalesce(valid, F.lit(False)).alias("valid"), F.timestamp_micros(F.when(valid, F.floor(at * _US)).cast("bigint")).alias("observed_at"), F.when(valid, value).alias("value"))


def sample_dedup(samples: DataFrame) -> DataFrame:
    """One valid sample for each series and instant: the last one given."""
    return samples.filter("valid").groupBy("series_hash", "metric_type", "instance", "observed_at").agg(F.max_by("value", "pos").alias("value"))


def metrics_scan_summary(series: DataFrame) -> DataFrame:
    """One row of counts; a dropped twin counts among all series and samples, but is neither supported nor not."""
    kept = F.col("kept")
    per = series.agg(
        F.count("*").alias("total_series"),
        F.count_if(kept).alias("supported_series"),
        F.count_if(~kept & ~F.col("aliased")).alias("unsupported_series"),
        F.coalesce(F.sum(F.greatest(F.size("values"), F.lit(0))), F.lit(0)).cast("bigint").alias("total_samples"),
        F.count_distinct(F.when(kept & (F.col("instance") != ""), F.col("instance"))).alias("instances"),
        F.array_sort(F.collect_set(F.when(kept, F.col("metric_type")))).alias("metric_types"),
    )
    raw = raw_samples(series)
    own = sample_dedup(raw).agg(F.count("*").alias("valid_samples"), F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"))
    bad = raw.agg(F.count_if(~F.col("valid")).alias("discarded_samples"))
    return per.crossJoin(F.broadcast(own)).crossJoin(F.broadcast(bad))


def samples_join_series(samples: DataFrame, series: DataFrame) -> DataFrame:
    """Samples with their series' columns. Up to BROADCAST_SERIES series are broadcast; more are joined by their hash.

    The series are stored before they are counted, for they come out of whole matrices.
    """
    extra = stored(series.select("series_hash", *[c for c in series.columns if c not in samples.columns and c not in ("values", "series_hash")]), "series")
    few = extra.limit(BROADCAST_SERIES + 1).count() <= BROADCAST_SERIES
    return samples.join(F.broadcast(extra) if few else extra, "series_hash")


def samples_in_window(samples: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return samples.filter(window_membership(F.col("observed_at"), start, end, exclusive=False))


def predecessor_sample(samples: DataFrame, start: datetime) -> DataFrame:
    """Of each series the last sample before the window."""
    rest = [c for c in samples.columns if c != "series_hash"]
    before = samples.filter(F.col("observed_at") < F.lit(start)).groupBy("series_hash").agg(F.max_by(F.struct(*rest), "observed_at").alias("r"))
    return before.select("series_hash", "r.*").select(*samples.columns)


def predecessors(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """window_id and the last sample before each of many windows (window_id, from_at, ..), of each series that has one.

    The windows' starts are the ranges that samples fall in: a grouped maximum leaves the last
    sample of each series and range, and it serves all starts up to the next one that has a
    sample of its own. No sample meets a window that it doesn't precede. The distinct starts
    go through the driver in blocks of MAX_STARTS.
    """
    known = windows.filter(F.col("from_at").isNotNull())
    starts = [r["t"] for r in known.select(F.unix_micros("from_at").alias("t")).distinct().orderBy("t").toLocalIterator()]
    out = None
    for k in range(0, max(len(starts), 1), MAX_STARTS):
        block = starts[k : k + MAX_STARTS]
        here = _block_predecessors(samples, known, block)
        out = here if out is None else out.unionByName(here)
    return out


def _block_predecessors(samples: DataFrame, windows: DataFrame, starts: list[int]) -> DataFrame:
    rest = [c for c in samples.columns if c != "series_hash"]
    part, until, start = unused(samples, "_range", "_until", "_start")
    last = starts[-1] if starts else 0
    # a start cuts behind the samples before it: a sample at the start is not before it
    cut = with_range(samples.filter(F.unix_micros("observed_at") < last), "observed_at", starts, part)
    lasts = cut.groupBy("series_hash", part).agg(F.max_by(F.struct(*rest), "observed_at").alias("r"))
    ends = lasts.withColumn(until, F.coalesce(F.lead(part).over(Window.partitionBy("series_hash").orderBy(part)) - 1, F.lit(len(starts) - 1)))
    each = ends.withColumn(start, F.explode(F.sequence(part, until)))
    numbered = with_range(windows.filter(F.unix_micros("from_at").between(starts[0] if starts else 1, last)), "from_at", starts, start).select("window_id", (F.col(start) - 1).alias(start))
    return numbered.join(each, start).select("window_id", "series_hash", "r.*").select("window_id", *samples.columns)


def boundary_union(samples: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The window's samples and the one before it of each series, in one pass: those before the window are reduced to the last on the map side."""
    (inside,) = unused(samples, "_inside")
    rest = [c for c in samples.columns if c != "series_hash"]
    upto = samples.filter(F.col("observed_at") <= F.lit(end)).withColumn(inside, F.when(F.col("observed_at") >= F.lit(start), F.col("observed_at")))
    kept = upto.groupBy("series_hash", inside).agg(F.max_by(F.struct(*rest), "observed_at").alias("r"))
    return kept.select("series_hash", "r.*").select(*samples.columns)


def series_count(samples: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return samples_in_window(samples, start, end).agg(F.count_distinct("series_hash").alias("series"))


def cluster_gauge(samples: DataFrame, metric: str, maximum: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Across members at each instant: the largest value, or the smallest above 0 (else a value as it is)."""
    own = samples.filter(F.col("metric_type") == metric).groupBy(*by, "observed_at")
    if maximum:
        return own.agg(F.max("value").alias("value"))
    return own.agg(F.coalesce(F.min(F.when(F.col("value") > 0, F.col("value"))), F.max("value")).alias("value"))


def _micros(c: str | Column) -> Column:
    return F.unix_micros(c)


def _steps(curve: DataFrame, by: tuple[str, ...], cuts: Cuts | None) -> DataFrame:
    """curve with ``previous`` (observed_at, value) and ``gap`` in microseconds; ranges of time are windows of their own."""
    cuts = time_cuts(curve) if cuts is None else cuts
    return previous(curve, by, "observed_at", ["value"], cuts).withColumn("gap", _micros("observed_at") - _micros("previous.observed_at"))


def _median(steps: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Lower median of the gaps above 0 of each group, from their counts: memory grows with the distinct gaps."""
    counted = steps.groupBy(*by, F.when(F.col("gap") > 0, F.col("gap")).alias("gap")).agg(F.count(F.when(F.col("gap") > 0, 1)).alias("n"))
    upto = counted.select(*by, "gap", F.sum("n").over(Window.partitionBy(*by).orderBy("gap")).alias("upto"), F.sum("n").over(Window.partitionBy(*by)).alias("all"))
    return upto.groupBy(*by).agg(F.coalesce(F.min(F.when((F.col("gap") > 0) & (2 * F.col("upto") >= F.col("all")), F.col("gap"))), F.lit(0)).cast("bigint").alias("median_us"))


def median_interval(curve: DataFrame, by: tuple[str, ...] = (), cuts: Cuts | None = None) -> DataFrame:
    """One row for each curve: its lower median step in microseconds, 0 without steps."""
    return _median(_steps(curve, by, cuts), by)


def _with_median(steps: DataFrame, by: tuple[str, ...]) -> DataFrame:
    medians = _median(steps, by)
    return steps.join(medians, list(by)) if by else steps.crossJoin(F.broadcast(medians))


def has_gap(curve: DataFrame, by: tuple[str, ...] = (), cuts: Cuts | None = None) -> DataFrame:
    """Whether a step is over three times the median, or there is no median."""
    steps = _with_median(_steps(curve, by, cuts), by)
    return steps.groupBy(*by).agg((F.coalesce(F.max("median_us") <= 0, F.lit(True)) | F.coalesce(F.max(F.col("gap") > 3 * F.col("median_us")), F.lit(False))).alias("has_gap"))


def curve_delta(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    change = F.max_by("value", "observed_at") - F.min_by("value", "observed_at")
    return curve.groupBy(*by).agg(F.when(F.count("*") < 2, F.lit(0.0)).otherwise(change).alias("delta"))


def growth_start(curve: DataFrame, thresholds: DataFrame | float, by: tuple[str, ...] = (), cuts: Cuts | None = None) -> DataFrame:
    """Start of the first three points in a row above the threshold; a gap or a lower point breaks the row.

    ``thresholds`` is a number, or a table of (by.., threshold).
    """
    cuts = time_cuts(curve) if cuts is None else cuts
    marked = _with_median(_steps(curve, by, cuts), by)
    marked = marked.withColumn("threshold", F.lit(float(thresholds))) if isinstance(thresholds, (int, float)) else (marked.join(thresholds, list(by)) if by else marked.crossJoin(F.broadcast(thresholds)))
    marked = marked.withColumn("above", F.col("value") > F.col("threshold"))
    apart = (F.col("median_us") > 0) & F.coalesce(F.col("gap") > 3 * F.col("median_us"), F.lit(False))
    broken = running(marked, by, "observed_at", F.when(apart | ~F.col("above"), 1).otherwise(0), cuts, "island")
    runs = broken.filter("above").groupBy(*by, "island").agg(F.count("*").alias("n"), F.min("observed_at").alias("start"))
    found = runs.filter("n >= 3").groupBy(*by).agg(F.min("start").alias("growth_started_at"))
    every = curve.select(*by).distinct() if by else None
    return found if every is None else every.join(found, list(by), "left")


def largest_growth(curve: DataFrame, by: tuple[str, ...] = (), cuts: Cuts | None = None) -> DataFrame:
    """(from_at, to_at, delta): the largest rise between neighbours that no gap divides, the earliest of equals."""
    steps = _with_median(_steps(curve, by, cuts), by).select(*by, "median_us", F.col("previous.observed_at").alias("from_at"), F.col("observed_at").alias("to_at"), (F.col("value") - F.col("previous.value")).alias("delta"), "gap")
    good = steps.filter((F.col("delta") > 0) & ~((F.col("median_us") > 0) & (F.col("gap") > 3 * F.col("median_us"))))
    best = F.max_by(F.struct("from_at", "to_at", "delta"), F.struct("delta", -_micros("to_at")))
    return good.groupBy(*by).agg(best.alias("r")).filter("r is not null").select(*by, "r.*")


def curve_peak(curve: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(observed_at, value) of the earliest largest value above 0; without one, no time and 0."""
    above = F.when(F.col("value") > 0, F.struct("value", (-_micros("observed_at")).alias("t")))
    return curve.groupBy(*by).agg(F.max(above).alias("p")).select(*by, F.timestamp_micros(-F.col("p.t")).alias("peak_at"), F.coalesce("p.value", F.lit(0.0)).alias("peak_value"))


def counter_rate(samples: DataFrame, metric: str, start: datetime, end: datetime, by: tuple[str, ...] = (), cuts: Cuts | None = None) -> DataFrame:
    """Rate a second at each instant, the largest across series; resets and gaps give no rate.

    ``samples`` may hold one sample before the window for each series.
    """
    own = samples.filter(F.col("metric_type") == metric).select(*by, "series_hash", "observed_at", "value")
    steps = _steps(own, (*by, "series_hash"), cuts)
    rated = _rates(steps, (*by, "series_hash")).filter(window_membership(F.col("observed_at"), start, end, exclusive=False))
    return rated.filter("rate > 0").groupBy(*by, "observed_at").agg(F.max("rate").alias("value"))


def _rates(steps: DataFrame, each: tuple[str, ...]) -> DataFrame:
    """steps with ``rate``, null at resets and gaps."""
    delta = F.col("value") - F.col("previous.value")
    good = (F.col("gap") > 0) & (delta >= 0) & ~((F.col("median_us") > 0) & (F.col("gap") > 3 * F.col("median_us")))
    return _with_median(steps, each).withColumn("rate", F.when(good, delta / (F.col("gap") / _US)))


def histogram_merge(samples: DataFrame, metric: str, by: tuple[str, ...] = (), cuts: Cuts | None = None) -> DataFrame:
    """(observed_at, le, count): rises of cumulative buckets since the sample before, summed across members."""
    own = samples.filter((F.col("metric_type") == metric) & F.col("histogram_le").isNotNull()).select(*by, "series_hash", "observed_at", "histogram_le", "value")
    rises = _steps(own, (*by, "series_hash"), cuts).select(*by, "observed_at", F.col("histogram_le").alias("le"), (F.col("value") - F.col("previous.value")).alias("rise"))
    return rises.filter("rise >= 0").groupBy(*by, "observed_at", "le").agg(F.sum("rise").alias("count"))


def histogram_quantile(samples: DataFrame, metric: str, q: float, by: tuple[str, ...] = (), cuts: Cuts | None = None) -> DataFrame:
    """Quantile at each instant, linear inside a bucket; the open bucket gives the bound below it.

    ``samples`` are those of the window, with histogram_le.
    """
    return merged_quantile(histogram_merge(samples, metric, by, cuts), q, by)


def merged_quantile(merged: DataFrame, q: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Quantile at each instant of merged buckets (by.., observed_at, le, count)."""
    up = Window.partitionBy(*by, "observed_at").orderBy("le")
    whole = Window.partitionBy(*by, "observed_at")
    steps = merged.select(*by, "observed_at", "le", "count", F.coalesce(F.lag("le").over(up), F.lit(0.0)).alias("lower"), F.coalesce(F.lag("count").over(up), F.lit(0.0)).alias("before"), F.max_by("count", "le").over(whole).alias("all"))
    target = F.col("all") * q
    inside = F.when(F.col("le") == float("inf"), F.col("lower")).when(F.col("count") <= F.col("before"), F.col("le")).otherwise(F.col("lower") + (F.col("le") - F.col("lower")) * (target - F.col("before")) / (F.col("count") - F.col("before")))
    hit = steps.filter("all > 0").withColumn("_v", inside).groupBy(*by, "observed_at")
    return hit.agg(F.coalesce(F.min_by(F.when(F.col("count") >= target, F.col("_v")), F.when(F.col("count") >= target, F.col("le"))), F.lit(0.0)).alias("value"))


def downsample_minmax(curve: DataFrame, limit: int = 600, by: tuple[str, ...] = (), cuts: Cuts | None = None) -> DataFrame:
    """At most ``limit`` points: the least and the largest of each of limit / 2 runs, the earliest of equals."""
    cuts = time_cuts(curve) if cuts is None else cuts
    sizes = curve.groupBy(*by).agg(F.count("*").alias("n"))
    sized = curve.select(*by, "observed_at", "value")
    sized = sized.join(sizes, list(by)) if by else sized.crossJoin(F.broadcast(sizes))
    numbered = running(sized, by, "observed_at", F.lit(1), cuts, "i").withColumn("i", F.col("i") - 1)
    runs = limit // 2
    run = F.when(F.col("n") <= limit, F.col("i")).otherwise(F.floor(((F.col("i") + 1) * runs - 1) / F.col("n")))
    at = _micros("observed_at")
    picked = numbered.groupBy(*by, run.alias("run")).agg(F.min_by(F.struct("observed_at", "value"), F.struct("value", at)).alias("low"), F.max_by(F.struct("observed_at", "value"), F.struct("value", -at)).alias("high"))
    return picked.select(*by, F.explode(F.array_distinct(F.array("low", "high"))).alias("p")).select(*by, "p.*")


def same_instant_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(on.., left_value, right_value) where both sides have the very same instant."""
    return left.select(*on, F.col("value").alias("left_value")).join(right.select(*on, F.col("value").alias("right_value")), on)


def quota_peak_ratio(db_total: DataFrame, quota: DataFrame) -> DataFrame:
    both = same_instant_join(db_total, quota, ["observed_at"]).filter("right_value > 0")
    return both.agg(F.greatest(F.coalesce(F.max(F.col("left_value") / F.col("right_value")), F.lit(0.0)), F.lit(0.0)).alias("quota_peak_ratio"))


def reclaimable_max(samples: DataFrame) -> DataFrame:
    """Largest total minus in-use of an instance at an instant, 0 at least."""
    own = lambda m: samples.filter(F.col("metric_type") == m).select("instance", "observed_at", "value")
    both = same_instant_join(own("db_total_bytes"), own("db_in_use_bytes"), ["instance", "observed_at"])
    return both.agg(F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("left_value") - F.col("right_value")), F.lit(0.0))).alias("max_defrag_reclaimable_bytes"))


def temporally_aligned(peak: Column, start: Column, end: Column, tolerance_us: Column) -> Column:
    """Whether the peak lies in the interval, made wider by the tolerance on both sides."""
    return F.coalesce(_micros(peak).between(_micros(start) - tolerance_us, _micros(end) + tolerance_us), F.lit(False))


def metrics_coverage(curve: DataFrame, samples: DataFrame, series: DataFrame, start: datetime, end: datetime, cuts: Cuts | None = None) -> DataFrame:
    """One row: how well the growth curve covers the window.

    full: a point at each end and no gap; partial: points, or other samples in the window;
    none: series without any; unknown: no series.
    """
    ends = curve.agg(F.min("observed_at").alias("a"), F.max("observed_at").alias("b"))
    inside = samples_in_window(samples, start, end).limit(1).agg(F.count("*").alias("inside"))
    some = series.limit(1).agg(F.count("*").alias("series"))
    gap = has_gap(curve, cuts=cuts)
    row = ends.crossJoin(inside).crossJoin(some).crossJoin(gap)
    full = (F.col("a") <= F.lit(start)) & (F.col("b") >= F.lit(end)) & ~F.col("has_gap")
    return row.select(F.when(F.col("a").isNull(), F.when(F.col("inside") > 0, "partial").when(F.col("series") > 0, "none").otherwise("unknown")).when(full, "full").otherwise("partial").alias("coverage"))


def timeline_bounds(samples: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """(from_at, to_at): the given bounds, made wider by samples outside, else those of the samples."""
    ends = samples.agg(F.min("observed_at").alias("a"), F.max("observed_at").alias("b"))
    return ends.select(F.least("a", F.lit(start).cast("timestamp")).alias("from_at"), F.greatest("b", F.lit(end).cast("timestamp")).alias("to_at"))


def metrics_timeline(samples: DataFrame, start: datetime | None = None, end: datetime | None = None, metric_type: str | None = None, instance: str | None = None, number: int = 1, size: int = 100) -> DataFrame:
    """The samples of a page of series, by series and time: a row each, so that no series is gathered in one."""
    out = _filtered(samples, start, end, metric_type, instance)
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page must be at least 1 and its size between 1 and {MAX_PAGE}")
    ordered = out.select("metric_type", "instance", "series_hash").distinct().orderBy("metric_type", "instance", "series_hash")
    chosen = (ordered.offset((number - 1) * size) if number > 1 else ordered).limit(size)  # size rows
    series = ["metric_type", "instance", "series_hash"]
    return out.join(F.broadcast(chosen), series).select(*series, "observed_at", "value").orderBy(*series, "observed_at")


def _filtered(samples: DataFrame, start, end, metric_type, instance) -> DataFrame:
    out = samples
    if start is not None:
        out = out.filter(F.col("observed_at") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("observed_at") <= F.lit(end))
    for column, value in (("metric_type", metric_type), ("instance", instance)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


def metric_data(samples: DataFrame, start: datetime | None = None, end: datetime | None = None, metric_type: str | None = None, instance: str | None = None, number: int = 1, size: int = 100) -> DataFrame:
    """A page of samples by time, then series."""
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page must be at least 1 and its size between 1 and {MAX_PAGE}")
    ordered = _filtered(samples, start, end, metric_type, instance).orderBy("observed_at", "series_hash")
    return (ordered.offset((number - 1) * size) if number > 1 else ordered).limit(size)


def metric_curves(samples: DataFrame, start: datetime, end: datetime, limit: int = 600) -> DataFrame:
    """(metric_type, observed_at, value) of the seven curves of a window, each downsampled; one pass over the samples."""
    cells, cuts = window_cells(samples, start, end)
    own = {name: cell_curve(cells, name) for name in METRIC_TYPES}
    out = None
    for name, curve in own.items():
        named = curve.select(F.lit(name).alias("metric_type"), "observed_at", "value")
        out = named if out is None else out.unionByName(named)
    assert out is not None
    return downsample_minmax(out, limit, ("metric_type",), cuts)


def window_cells(samples: DataFrame, start: datetime, end: datetime) -> tuple[DataFrame, list[int]]:
    """(cells, cuts) of a window: all that its curves need, from one pass over the samples.

    The steps of all series (each sample with the one before it) are stored once; the cells are
    one grouped aggregate of them, a row for each metric, instant and, where they matter,
    instance or bucket, and are stored too: what reads them reads a small table.
    """
    near = boundary_union(samples, start, end).select("series_hash", "metric_type", "instance", "histogram_le", "observed_at", "value")
    near = stored(near, "near")
    cuts = time_cuts(near)
    steps = _steps(near, ("series_hash",), cuts).filter(window_membership(F.col("observed_at"), start, end, exclusive=False))
    kind = F.col("metric_type")
    rise = F.col("value") - F.col("previous.value")
    inside = F.col("previous.observed_at") >= F.lit(start)  # buckets count from the window's first sample on
    cells = _rates(steps, ("series_hash",)).groupBy(
        "metric_type", "observed_at", F.when(kind.isin("db_total_bytes", "db_in_use_bytes"), F.col("instance")).alias("instance"), F.when(kind.isin(*HISTOGRAMS), F.col("histogram_le")).alias("le")
    ).agg(
        F.max("value").alias("most"),
        F.min("value").alias("least"),
        F.min(F.when(F.col("value") > 0, F.col("value"))).alias("least_above"),
        F.sum(F.when(inside & (rise >= 0), rise)).alias("count"),
        F.max(F.when(F.col("rate") > 0, F.col("rate"))).alias("rate"),
    )
    return stored(cells, "cells"), cuts


def cell_curve(cells: DataFrame, metric: str, q: float = 0.99) -> DataFrame:
    """The curve (observed_at, value) of a metric: its gauge, rate or quantile."""
    own = cells.filter(F.col("metric_type") == metric)
    each = own.groupBy("observed_at")
    if metric in HISTOGRAMS:
        return merged_quantile(own.filter("le is not null and count is not null").select("observed_at", "le", "count"), q)
    if metric in RATES:
        return own.filter("rate is not null").groupBy("observed_at").agg(F.max("rate").alias("value"))
    if metric == "quota_bytes":
        return each.agg(F.coalesce(F.min("least_above"), F.max("most")).alias("value"))
    return each.agg(F.max("most").alias("value"))


def cell_reclaimable(cells: DataFrame) -> DataFrame:
    """As ``reclaimable_max``: of pairs at an instance and instant the largest total less the least in use."""
    pick = lambda m, c: F.max(F.when(F.col("metric_type") == m, F.col(c)))
    both = cells.filter(F.col("instance").isNotNull()).groupBy("instance", "observed_at").agg((pick("db_total_bytes", "most") - pick("db_in_use_bytes", "least")).alias("free"))
    return both.agg(F.greatest(F.lit(0.0), F.coalesce(F.max("free"), F.lit(0.0))).alias("max_defrag_reclaimable_bytes"))


def metrics_evidence(samples: DataFrame, series: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """One row of what the metrics show in [start, end]; ``samples`` carry histogram_le, may begin before it, and are read once."""
    cells, cuts = window_cells(samples, start, end)
    total, in_use = cell_curve(cells, "db_total_bytes"), cell_curve(cells, "db_in_use_bytes")
    named = total.withColumn("m", F.lit("db_total_bytes")).unionByName(in_use.withColumn("m", F.lit("db_in_use_bytes")))
    which = named.agg(F.max("m").alias("growth_metric"))  # db_total_bytes sorts after db_in_use_bytes
    growth = named.join(F.broadcast(which), F.col("m") == F.col("growth_metric")).select("observed_at", "value")
    base = growth.agg(F.min_by("value", "observed_at").alias("growth_baseline_bytes")).withColumn("growth_threshold_bytes", F.when(F.col("growth_baseline_bytes").isNotNull(), F.greatest(F.lit(LEAST_GROWTH), F.col("growth_baseline_bytes") * 0.01)))
    started = growth_start(growth, base.select((F.col("growth_baseline_bytes") + F.col("growth_threshold_bytes")).alias("threshold")), cuts=cuts)
    one = lambda df: df.agg(*[F.first(c).alias(c) for c in df.columns])  # noqa: E731  a row in any case
    peak = lambda df, name: one(curve_peak(df)).select(F.col("peak_at").alias(f"{name}_at"), F.coalesce("peak_value", F.lit(0.0)).alias(name))
    interval = one(largest_growth(growth, cuts=cuts)).select(F.col("from_at").alias("largest_growth_from"), F.col("to_at").alias("largest_growth_to"), F.col("delta").alias("largest_growth_bytes"))
    parts = [
        metrics_coverage(growth, cells, series, start, end, cuts),
        which.select(F.coalesce("growth_metric", F.lit("db_in_use_bytes")).alias("growth_metric")),
        base.select(F.coalesce("growth_baseline_bytes", F.lit(0.0)).alias("growth_baseline_bytes"), F.coalesce("growth_threshold_bytes", F.lit(0.0)).alias("growth_threshold_bytes")),
        one(started),
        one(curve_delta(total)).select(F.coalesce("delta", F.lit(0.0)).alias("db_total_delta_bytes")),
        one(curve_delta(in_use)).select(F.coalesce("delta", F.lit(0.0)).alias("db_in_use_delta_bytes")),
        interval,
        one(median_interval(growth, cuts=cuts)),
        peak(cell_curve(cells, "put_total"), "peak_put_rate"),
        peak(cell_curve(cells, "delete_total"), "peak_delete_rate"),
        quota_peak_ratio(total, cell_curve(cells, "quota_bytes")),
        cell_reclaimable(cells),
        peak(cell_curve(cells, "backend_commit_seconds"), "backend_commit_p99"),
        peak(cell_curve(cells, "wal_fsync_seconds"), "wal_fsync_p99"),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(F.broadcast(p))  # one row each
    near = lambda at: temporally_aligned(F.col(at), F.col("largest_growth_from"), F.col("largest_growth_to"), F.coalesce("median_us", F.lit(0)))
    return row.withColumns({"put_temporally_aligned": near("peak_put_rate_at"), "delete_temporally_aligned": near("peak_delete_rate_at")}).drop("median_us")
