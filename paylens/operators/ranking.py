"""Ranking inside groups and along an ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import pct


def top_per_group(df: DataFrame, groups: list[str], order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each group.

    With the limit on the rank, Spark keeps only ``top`` rows per group and task
    before it shuffles, so a large group does not travel.
    """
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("rank_", rank).where(F.col("rank_") <= top).drop("rank_")


def change_from_previous(df: DataFrame, order: str, value: str, previous: str,
                         growth: str) -> DataFrame:
    """The value of the previous row of a short series and the change in percent."""
    before = F.lag(value).over(Window.orderBy(order))
    df = df.withColumn(previous, before)
    return df.withColumn(growth, F.expr(pct(f"({value} - {previous})", previous)))
