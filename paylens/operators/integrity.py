"""Key, reference, NULL and rule checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import tally
from .joins import rows_with_key_in
from .sizing import fits_broadcast


def unmatched_keys(child: DataFrame, on: str, parent: DataFrame, parent_on: str) -> DataFrame:
    """Child keys without a parent, with their row counts (``on``, ``n``).

    The child is reduced to one row per key before the join, so a hot key costs
    nothing, and repeated parent keys are reduced likewise. If the child is
    small, its keys are broadcast and the parent is filtered without a shuffle.
    NULL keys stay unmatched.
    """
    per_key = child.groupBy(F.col(on).alias(on)).agg(F.count(F.lit(1)).alias("n"))
    parents = parent.select(F.col(parent_on).alias(on))
    if fits_broadcast(child):
        parents = rows_with_key_in(parents, per_key.select(on), on)
    return per_key.join(parents.distinct(), on, "left_anti")


def orphans(
    child: DataFrame, on: str, parent: DataFrame, parent_on: str, name: str,
    skip_null: bool = False,
) -> DataFrame:
    """Number of child rows whose key has no parent (NOT EXISTS)."""
    if skip_null:
        child = child.where(F.col(on).isNotNull())
    missing = unmatched_keys(child, on, parent, parent_on)
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias(name))


def repeated_keys(df: DataFrame, key: str, name: str = "row_count", bits: int = 64) -> DataFrame:
    """Keys of several rows, with their row counts; NULL is a key like any other.

    Rows are counted by a hash of the key first, 8 bytes each; only rows whose hash repeats
    are counted by the key itself, so different keys with one hash are told apart. ``bits``
    of the hash are used.
    """
    hashed = df.select(F.col(key), F.shiftright(F.xxhash64(key), 64 - bits).alias("hash_"))
    often = hashed.groupBy("hash_").agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    suspects = hashed.join(often.select("hash_"), "hash_", "left_semi")
    return suspects.groupBy(key).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def null_counts(columns: Sequence[str], names: dict[str, str] | None = None) -> list[Column]:
    names = names or {}
    return [F.expr(f"{tally(f'{c} IS NULL')} AS {names.get(c, c)}") for c in columns]


def range_check(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.agg(
        F.min(column).alias("min_risk"),
        F.max(column).alias("max_risk"),
        F.expr(f"{tally(f'{column} < {low} OR {column} > {high}')} AS out_of_range"),
    )
