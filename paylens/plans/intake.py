"""Cleaning and loading, run on data derived from the tables (E1-E19)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import TABLES
from ..session import released_shuffles, shared_folder
from ..sources import files
from ..sources.cleaning import clean
from ..sources.full_load import run_load
from ..sources.store import load, load_report, new_rows, quality_report, read_stored
from .catalog import report
from .common import ALERTS, CUSTOMERS, TXN


def raw_text(t, name: str) -> DataFrame:
    """A table as it would arrive: text only, with an unreadable date where none is set."""
    df = t.scan(name)
    text = {c: F.col(c).cast("string") for c in df.columns}
    if name == ALERTS:
        text["resolution_date"] = F.coalesce(text["resolution_date"], F.lit("not yet"))
    return df.select(*[text.get(c, F.lit("none given")).alias(c) for c in TABLES[name].names])


# Inventory number of the cleaning step of each table.
_CLEANERS = {"customer_details": 3, "customer_feedback": 4, "device_info": 5, "fraud_alert": 6,
             "merchant": 7, "account_details": 8, "transaction_history": 9}


def _register(name: str, number: int) -> None:
    @report(f"e{number:02d}_clean_{name}")
    def cleaned(t):
        return clean(name, raw_text(t, name))


for _name, _number in _CLEANERS.items():
    _register(_name, _number)


@report("e14_new_transactions", stored_before="2000-01-01 00:00:00")
def new_transactions(t, stored_before):
    """All transactions arrive; those before a moment are stored already."""
    arriving = t.scan(TXN)
    moment = F.lit(stored_before).cast("timestamp_ntz")
    stored = t.scan(TXN, "transaction_id", "timestamp").where(F.col("timestamp") < moment)
    return new_rows(arriving, stored, "transaction_id")


@contextmanager
def _home(t):
    """A session and a folder of its own for loads."""
    spark = t.scan(TXN, "transaction_id").sparkSession
    home = f"{shared_folder(spark)}/loads/{uuid.uuid4().hex}"
    try:
        with released_shuffles(spark):
            yield spark, home
    finally:
        files.remove(spark, home)


def _as_csv(t, folder: str) -> None:
    """Packed, as text takes several times the room of the tables it is made from."""
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    for name, table in TABLES.items():
        raw_text(t, name).write.option("header", True).option("escape", '"').options(
            **packed).csv(f"{folder}/{table.raw_name}.csv")


@report("e19_load_from_csv")
def load_from_csv(t):
    """Write the tables as CSV, load them, and load them again as a second batch."""
    with _home(t) as (spark, home):
        _as_csv(t, f"{home}/in")
        first = run_load(spark, f"{home}/in", f"{home}/out", "first")
        second = run_load(spark, f"{home}/in", f"{home}/out", "second")
    return load_report(spark, first + second)


@report("e10_load_quality")
def load_quality(t):
    """What a load of the tables from CSV says about NULL cells and lost values."""
    with _home(t) as (spark, home):
        _as_csv(t, f"{home}/in")
        results = run_load(spark, f"{home}/in", f"{home}/out", "first")
    return quality_report(spark, results)


@report("e18_batches")
def batches(t):
    """Customers in batches with odd names, one of them repeated with fewer rows.

    A line per load, with the rows that the table then holds of the repeated batch.
    """
    steps = [("2024-06-01", "k < 2"), ("0af3", "k < 3"), ("2024-06-01", "k < 1"),
             ("1e3", "k < 3"), ("2024-06-01", "k < 0")]
    results, held = [], []
    with _home(t) as (spark, home):
        rows = clean(CUSTOMERS, raw_text(t, CUSTOMERS)).withColumn(
            "k", F.expr("CAST(customer_id AS BIGINT) % 3"))
        for batch, test in steps:
            results.append(load(spark, rows.where(test).drop("k"), CUSTOMERS, home, batch))
            stored = read_stored(spark, CUSTOMERS, f"{home}/{CUSTOMERS}")
            held.append(stored.where(F.col("batch_id") == "2024-06-01").count())
    lines = [(k, batch, *result.row()[1:], n)
             for k, ((batch, _), result, n) in enumerate(zip(steps, results, held))]
    return spark.createDataFrame(
        lines, "step int, batch string, action string, rows_before long, rows_incoming long,"
        " rows_inserted long, rows_skipped long, rows_after long, held_of_repeated long")


@report("q16_01_vw_executive_kpis_by_batch")
def kpis_by_batch(t):
    """The KPI view from shares per batch: transactions come in three batches, one repeated,
    and a third of the customers after them."""
    from .kept_views import KeptViews  # stored tables only

    spark = t.scan(TXN, "transaction_id").sparkSession
    home = f"{shared_folder(spark)}/loads/{uuid.uuid4().hex}"  # what the result reads stays
    views = KeptViews(spark, home, f"{home}-views")
    txns, people = (clean(name, raw_text(t, name)) for name in (TXN, CUSTOMERS))
    third = "pmod(xxhash64({}), 3)"
    late, part = third.format("customer_id"), third.format("transaction_id")
    steps = [(CUSTOMERS, people.where(f"{late} > 0"), "a"), (TXN, txns.where(f"{part} = 0"), "a"),
             (TXN, txns.where(f"{part} = 0 AND amount > 0"), "b"),
             (TXN, txns.where(f"{part} = 1"), "b"), (CUSTOMERS, people, "b"),
             (TXN, txns, "c")]
    for name, rows, batch in steps:
        load(spark, rows, name, home, batch)
        if name == TXN:
            views.refresh()
    return views.executive_kpis()
