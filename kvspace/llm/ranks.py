"""Numbers within groups of any size, and joins to them, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvspace.llm.store import materialize
from kvspace.llm.text import unused

#: Parts that each group is numbered in; a group of n rows is at most about n / PARTS rows in a task.
PARTS = 256
#: Rows that a part should have at most, where the size of the groups is known.
PART_ROWS = 100_000


#: Parts that the rows of one key are dealt to in a join.
SALTS = 64


def attach(df: DataFrame, groups: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """df joined to one row for each value of ``key``; the rows of one value are dealt to ``salts`` parts.

    The parts that a value has are found with map-side combining, so no task holds a value's
    rows, and the smaller side has a row for each part that there is, not for each that may be.
    Rows whose key is null or not in groups are left out.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    spread = salted.select(key, "_salt").distinct().join(groups, key)
    return salted.join(spread, [key, "_salt"]).drop("_salt")


def number_within(df: DataFrame, group: str, order: list[str], name: str, part: Column | None = None, parts: int = PARTS) -> DataFrame:
    """df with a long ``name``: 0, 1, 2, .. within each value of ``group``.

    Each group is dealt by a hash of ``order`` into parts, parts are numbered by themselves and
    their sizes are summed up. The order of the numbers is that of the parts, then of the
    columns; rows that tie in all of them (repeated rows) get some order of their own.
    The table of part sizes has at most parts rows for each group.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    within = Window.partitionBy(group, "_part").orderBy(*order)
    sizes = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = dealt.withColumn("_number", F.row_number().over(within) - 1)
    return ranked.join(starts, [group, "_part"]).withColumn(name, (F.col("_number") + F.col("_start")).cast("long")).drop("_number", "_start", "_part")


def number_all(df: DataFrame, order: list[Column], name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """df with a long ``name``: 1, 2, 3, .. over all rows in the given order; a task numbers one range of them.

    The rows are written once, dealt by ranges of the order (rows that tie in it are split by a
    number of their own), and each range adds the sizes of those before it: one row for each
    range. A column that has the name is replaced.
    """
    tie, part, before = (unused(df, n) for n in ("_tie", "_part", "_before"))
    tied = materialize(df.drop(name).withColumn(tie, F.monotonically_increasing_id()), "unnumbered")
    parts = max(1, -(-tied.count() // part_rows))
    ranges = materialize(tied.repartitionByRange(parts, *order, F.col(tie)).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy(part).agg(F.count("*").alias("n"))
    starts = sizes.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    within = Window.partitionBy(part).orderBy(*order, F.col(tie))
    numbered = ranges.withColumn(name, F.row_number().over(within)).join(F.broadcast(starts), part)
    return numbered.withColumn(name, (F.col(name) + F.col(before)).cast("long")).drop(tie, part, before)
