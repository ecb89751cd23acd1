"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns, computed once for each row.

    They come out of a generator of one row. Neither projections nor filters are merged
    through it, so what later steps and queries do with a column never repeats its expression.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select("*", made.alias("_step")).select("*", "_step.*").drop("_step")
