"""Turns one wide row into several narrow ones."""

from __future__ import annotations

from pyspark.sql import DataFrame


def as_lines(df: DataFrame, lines: list[dict[str, str]]) -> DataFrame:
    """One output row per entry of ``lines`` (column name to SQL) and input row."""
    structs = ", ".join(
        "struct(" + ", ".join(f"{sql} AS {name}" for name, sql in line.items()) + ")"
        for line in lines
    )
    return df.selectExpr(f"inline(array({structs}))")
