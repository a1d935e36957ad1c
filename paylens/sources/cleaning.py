"""Gives raw text columns their declared types (E3-E9, E11)."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model

Formats = Mapping[str, Sequence[str]] | None  # column name to date patterns

# Texts that stand for a missing value in the incoming files.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _readable(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegerType):  # a whole number may be written as 25.0
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("int"))
    return text.try_cast(kind)


def _in_formats(text: Column, kind: T.DataType, formats: Sequence[str]) -> Column:
    """As ISO text, else by the first format that fits."""
    value = _readable(text, kind)
    if not isinstance(kind, (T.DateType, T.TimestampNTZType)):
        return value
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz").cast(kind) for f in formats]
    return F.coalesce(value, *tried) if tried else value


def _typed(table: model.Table, column: model.Column, formats: Sequence[str] = ()) -> Column:
    raw = F.col(column.name)
    text = F.when(~raw.isin(*MISSING), raw)
    if isinstance(column.type, T.StringType):
        return text
    value = _in_formats(text, column.type, formats)
    if column.lenient:
        return value
    complaint = F.concat(F.lit(f"{table.name}.{column.name}: cannot read '"), text, F.lit("'"))
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(complaint)).otherwise(value)


def unread(name: str, raw: DataFrame, formats: Formats = None) -> DataFrame:
    """(column, lost): values of the lenient columns that become NULL although present."""
    table = model.TABLES[name]
    counts = [
        F.struct(F.lit(c.name).alias("column"), F.sum((
            F.col(c.name).isNotNull() & ~F.col(c.name).isin(*MISSING)
            & _typed(table, c, (formats or {}).get(c.name, ())).isNull()).cast("bigint"))
            .alias("lost"))
        for c in table.columns if c.lenient
    ]
    made = raw.agg(F.array(*counts).alias("all")) if counts else raw.limit(0).select(
        F.expr("CAST(array() AS ARRAY<STRUCT<column: STRING, lost: BIGINT>>)").alias("all"))
    return made.select(F.explode("all").alias("x")).select("x.*")


def clean(
    name: str, raw: DataFrame, fill_defaults: bool = False, formats: Formats = None,
) -> DataFrame:
    """Typed rows; no row is dropped.

    An unreadable value stops the job, whatever the ANSI setting, except in the
    one lenient column, where it becomes NULL. ``fill_defaults`` puts a declared
    default where a value is missing. Dates and moments are read as ISO text, then by
    the ``formats`` of their column, Spark date patterns tried in order.
    """
    table = model.TABLES[name]
    missing = [c for c in table.names if c not in raw.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    extra = [c for c in raw.columns if c not in table.names]
    if extra:
        warnings.warn(f"{name}: columns not in the table are left out: {extra}", stacklevel=2)
    columns = []
    for column in table.columns:
        value = _typed(table, column, (formats or {}).get(column.name, ()))
        if fill_defaults and column.default is not None:
            value = F.coalesce(value, F.lit(column.default))
        columns.append(value.alias(column.name))
    return raw.select(*columns)
