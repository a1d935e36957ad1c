"""Previews and column profiles of the tables (E10, E20-E26)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rates import tally
from ..model import TABLES
from ..operators.lines import as_lines
from ..operators.rollup import Where, rollup
from .catalog import report
from .common import ALERTS, TXN, desc, named


def preview(t, table: str, rows: int = 10) -> DataFrame:
    """The first rows in key order, those without a key before all.

    The key column alone tells the last key that is wanted; with it as a filter, files and
    row groups with larger keys are not opened for their other columns.
    """
    key = TABLES[table].key
    first = t.scan(table, key).orderBy(key).limit(rows)
    last, keyed, found = first.agg(F.max(key), F.count(key), F.count(F.lit(1))).first()
    wanted = F.lit(False) if last is None else F.col(key) <= F.lit(last)
    if keyed < found:
        wanted = wanted | F.col(key).isNull()
    return t.scan(table).where(wanted).orderBy(key).limit(rows)


def column_profile(t, table: str) -> DataFrame:
    """Type, non-null and NULL count of each column, from one scan."""
    df = t.scan(table)
    types = dict(df.dtypes)
    counted = df.agg(
        named("count(1)", "rows_"), *[named(f"count({c})", f"n_{c}") for c in df.columns]
    )
    return as_lines(counted, [
        {"table_name": f"'{table}'", "column_name": f"'{c}'", "data_type": f"'{types[c]}'",
         "non_null_count": f"n_{c}", "null_count": f"rows_ - n_{c}"}
        for c in df.columns
    ])


def null_cells(t, table: str) -> DataFrame:
    """Rows and NULL cells of the whole table."""
    df = t.scan(table)
    filled = " - ".join(f"count({c})" for c in df.columns)
    return df.agg(
        named(f"'{table}'", "table_name"), named("count(1)", "row_count"),
        named(f"count(1) * {len(df.columns)} - {filled}", "null_cells"),
    )


def value_counts(t, table: str, column: str, where: Where | None = None) -> DataFrame:
    """How often each value occurs, NULL left out, most frequent first."""
    return (
        rollup(t, table, [column], "rows", where).where(F.col(column).isNotNull())
        .withColumnRenamed("rows", "value_count").orderBy(desc("value_count"), column)
    )


def text_lengths(t, table: str) -> DataFrame:
    """The longest text of each text column."""
    df = t.scan(table)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    longest = df.agg(*[named(f"max(length({c}))", c) for c in texts])
    return as_lines(longest, [{"column_name": f"'{c}'", "max_length": c} for c in texts])


def _register(name: str) -> None:
    report(f"e10_null_cells_{name}")(lambda t: null_cells(t, name))
    report(f"e20_preview_{name}")(lambda t: preview(t, name))
    report(f"e21_profile_{name}")(lambda t: column_profile(t, name))


for _name in TABLES:
    _register(_name)


@report("e22_nulls_fraud_alert", table=ALERTS)
@report("e22_nulls_transaction_history", table=TXN)
def nulls_per_column(t, table):
    return column_profile(t, table).select("column_name", "null_count")


@report("e23_status_frequencies")
def status_frequencies(t):
    return value_counts(t, TXN, "status")


@report("e24_status_where_reason_given")
def status_where_reason_given(t):
    given = Where(("failure_reason",), "failure_reason IS NOT NULL")
    return value_counts(t, TXN, "status", given)


@report("e24_resolved_where_no_date")
def resolved_where_no_date(t):
    undated = Where(("resolution_date",), "resolution_date IS NULL")
    return value_counts(t, ALERTS, "resolved", undated)


@report("e25_null_merchants_by_type")
def null_merchants_by_type(t):
    return t.scan(TXN, "transaction_type", "merchant_id").groupBy("transaction_type").agg(
        named(tally("merchant_id IS NULL"), "null_merchant_ids")
    )


@report("e26_text_lengths_fraud_alert")
def alert_text_lengths(t):
    return text_lengths(t, ALERTS)
