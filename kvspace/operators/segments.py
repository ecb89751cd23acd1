"""Windows over ordered rows of groups of any size, without one task for a group.

Rows are cut by ranges of their order column, the same for all groups, so that each range has
about SEGMENT_ROWS rows; a window runs within (group, range), and what a range needs of the ones
before it (their last row, their sum) is carried over by one row for each group and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range of times should have.
SEGMENT_ROWS = 1_000_000

Cuts = Sequence[int]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def time_cuts(df: DataFrame, at: str = "observed_at", rows: int = SEGMENT_ROWS) -> list[int]:
    """Times in microseconds that cut df into ranges of about ``rows`` rows; none for a small table."""
    times = df.select(F.unix_micros(at).cast("double").alias("t")).filter("t is not null")
    parts = -(-times.count() // rows)
    if parts < 2:
        return []
    found = times.approxQuantile("t", [k / parts for k in range(1, parts)], 0.25 / parts)
    return sorted({int(t) for t in found})


def with_range(df: DataFrame, at: str, cuts: Cuts, name: str) -> DataFrame:
    """df with the number of its time's range, found by bisection; unknown times are in range -1."""
    if not cuts:
        return df.withColumn(name, F.when(F.col(at).isNull(), -1).otherwise(0))
    (t,) = unused(df, "_micros")
    timed = df.withColumn(t, F.unix_micros(at).cast("double"))
    split = Bucketizer(splits=[float("-inf"), *map(float, cuts), float("inf")], inputCol=t, outputCol=name, handleInvalid="keep").transform(timed)
    return split.withColumn(name, F.when(F.col(t).isNull(), -1).otherwise(F.col(name)).cast("int")).drop(t)


def _carry(df: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """df with the other columns of carried, which has a row for each value of the keys; nulls are equal."""
    other = carried.withColumnsRenamed({k: f"_on{i}" for i, k in enumerate(keys)})
    on: Column = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_on{i}"))
    return df.join(other, on).drop(*[f"_on{i}" for i in range(len(keys))])


def previous(df: DataFrame, by: tuple[str, ...], at: str, columns: list[str], cuts: Cuts, name: str = "previous") -> DataFrame:
    """df with a struct ``name`` of (at, columns) of the row before in its group; null for the first."""
    row = F.struct(at, *columns)
    if not cuts:
        return df.withColumn(name, F.lag(row).over(Window.partitionBy(*by).orderBy(at)))
    part, last = unused(df, "_range", "_last")
    cut = with_range(df, at, cuts, part)
    lasts = cut.groupBy(*by, part).agg(F.max_by(row, at).alias(last))
    carried = lasts.select(*by, part, F.lag(last).over(Window.partitionBy(*by).orderBy(part)).alias(last))
    own = cut.withColumn(name, F.lag(row).over(Window.partitionBy(*by, part).orderBy(at)))
    return _carry(own, carried, [*by, part]).withColumn(name, F.coalesce(name, last)).drop(part, last)


def running(df: DataFrame, by: tuple[str, ...], at: str, value: Column, cuts: Cuts, name: str) -> DataFrame:
    """df with ``name``, the sum of ``value`` over its group's rows up to its own."""
    if not cuts:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(at)))
    part, before = unused(df, "_range", "_before")
    cut = with_range(df, at, cuts, part)
    sums = cut.groupBy(*by, part).agg(F.sum(value).alias(before))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*by, part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    own = cut.withColumn(name, F.sum(value).over(Window.partitionBy(*by, part).orderBy(at)))
    return _carry(own, carried, [*by, part]).withColumn(name, F.col(name) + F.col(before)).drop(part, before)
