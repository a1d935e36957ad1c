"""Row-level joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizing import fits_broadcast

_SPREAD = 1 << 16


def small(df: DataFrame, times: int = 1) -> DataFrame:
    """Marked for broadcast if its size allows, otherwise as it is."""
    return F.broadcast(df) if fits_broadcast(df, times) else df


def rows_with_key_in(big: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of a large table whose key occurs in a smaller one.

    A semi join with the large table on the streamed side: few keys are
    broadcast, many are shuffled, and a hot key of the large table can be split.
    """
    return big.join(small(keys), on, "left_semi")


def left_lookup(df: DataFrame, lookup: DataFrame, on: str, spread_by: str) -> DataFrame:
    """Left join on a column that is often NULL.

    Rows without a key match nothing, yet would all hash to one partition. A
    second join column, which is 0 for every row that can match, spreads them. A small
    lookup is broadcast and needs none of this.
    """
    if fits_broadcast(lookup):
        return df.join(F.broadcast(lookup), on, "left")
    spread = F.when(F.col(on).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(_SPREAD)))
    left = df.withColumn("spread_", F.coalesce(spread, F.lit(0).cast("bigint")))
    right = lookup.withColumn("spread_", F.lit(0).cast("bigint"))
    return left.join(right, [on, "spread_"], "left").drop("spread_")


def left_join_many(df: DataFrame, many: DataFrame, on: str) -> DataFrame:
    """Left join to a table that may hold several rows for one key.

    ``df`` is the streamed side, whose hot keys adaptive execution splits; it is
    read and shuffled once. A small right side is broadcast instead.
    """
    return df.join(small(many), on, "left")
