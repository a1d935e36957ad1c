"""Aggregates over a chain of one-to-many joins without building its product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def children(df: DataFrame, on: str, **measures: str) -> DataFrame:
    """One row per parent, so that joining it multiplies nothing."""
    return df.groupBy(on).agg(*[F.expr(f"{sql} AS {name}") for name, sql in measures.items()])


def copies(*counts: str) -> str:
    """How often a row of one child is repeated by left-joining the others.

    A DECIMAL(38, 0), as the product of several children of one hot parent can
    exceed a BIGINT: exact, and an error beyond.
    """
    factors = " * ".join(f"greatest(coalesce({count}, 0), 1)" for count in counts)
    return f"(CAST(1 AS DECIMAL(38, 0)) * {factors})"


def times(count: str, every: str) -> str:
    """Sum of a count, each repeated ``every`` times, as a BIGINT; too large is an error."""
    return f"CAST(sum(coalesce({count}, 0) * {every}) AS BIGINT)"
