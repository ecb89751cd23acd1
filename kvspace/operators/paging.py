"""Sorted pages with a stable order, and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 500


def page(df: DataFrame, sorts: dict[str, str], sort: str, descending: bool, ties: tuple[str, ...], number: int = 1, size: int = 100) -> DataFrame:
    """Page ``number`` (from 1) of df, sorted by an allowed column and then by ``ties`` (a ``-`` before a name: descending)."""
    if sort not in sorts:
        raise ValueError(f"sort must be one of {sorted(sorts)}")
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page must be at least 1 and its size between 1 and {MAX_PAGE}")
    first = F.desc_nulls_last(sorts[sort]) if descending else F.asc_nulls_first(sorts[sort])
    rest = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in ties]
    ordered = df.orderBy(first, *rest)
    return (ordered.offset((number - 1) * size) if number > 1 else ordered).limit(size)


def page_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))
