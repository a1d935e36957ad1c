"""Helpers for long SQL expressions over one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def let(name: str, value: str, body: str) -> str:
    """SQL in which ``name`` stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def computed(df: DataFrame, kept: Sequence[str], made: str) -> DataFrame:
    """Columns ``kept`` and the fields of the struct ``made``.

    The generator is a barrier: a later filter on a field is not pushed below it,
    where it would compute the struct anew for every mention of a field.
    """
    return df.select(*kept, F.explode(F.array(F.expr(made))).alias("m_")).select(*kept, "m_.*")
