"""Share of a group in the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import pct


def with_share(grouped: DataFrame, count: str, name: str = "pct_share") -> DataFrame:
    """Adds each group's percentage of the total.

    The total is a scalar subquery on the grouped result: it reuses that
    result's shuffle, and no window gathers all the groups in one task.
    """
    total = grouped.agg(F.sum(count)).scalar()
    return grouped.withColumn("total_", total).withColumn(
        name, F.expr(pct(count, "total_"))
    ).drop("total_")
