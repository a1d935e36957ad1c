"""Step 5: fraud and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..functions.calendar import hours_crossed
from ..functions.rates import tally, whole_div
from ..operators.joins import left_join_many, rows_with_key_in
from ..operators.percentiles import exact_percentiles
from ..operators.rollup import Key, rollup, rollup_through
from .catalog import report
from .common import (
    ALERTS, CUSTOMERS, DEVICES, MERCHANTS, TXN, average, desc, month, n, named, rate, risk_band,
)


@report("q5_01_alert_types")
def alert_types(t):
    hours = hours_crossed("alert_date", "resolution_date")
    grouped = t.scan(ALERTS, "alert_type", "alert_date", "resolution_date", "resolved").groupBy(
        "alert_type"
    ).agg(
        named("count(1)", "alert_count"),
        named(tally("resolved"), "resolved_count"),
        named(tally("NOT resolved"), "open_count"),
        named(f"sum({hours})", "hours"),
        named(f"count({hours})", "timed"),
    )
    return grouped.select(
        "alert_type", "alert_count", "resolved_count", "open_count",
        rate("resolved_count", "resolution_rate_pct", "alert_count"),
        named(whole_div("hours", "timed"), "avg_resolution_hours"),
    ).orderBy(desc("alert_count"), "alert_type")


def _fraud_columns():
    return n("ids", "total_txns"), n("fraud", "fraud_txns"), rate("fraud", "fraud_rate_pct")


@report("q5_02_fraud_by_region")
def fraud_by_region(t):
    return rollup_through(
        t, TXN, CUSTOMERS, "customer_id", ["region"], "rows ids fraud"
    ).select("region", *_fraud_columns()).orderBy(desc("fraud_rate_pct"), "region")


@report("q5_03_fraud_by_device_type", by="device_type")
@report("q5_04_fraud_by_channel", by="channel")
def fraud_by(t, by):
    return rollup(t, TXN, [by], "rows fraud").select(
        by, n("rows", "total_txns"), n("fraud", "fraud_txns"), rate("fraud", "fraud_rate_pct"),
    ).orderBy(desc("fraud_rate_pct"), by)


@report("q5_05_fraud_by_rooted")
def fraud_by_rooted(t):
    return rollup_through(
        t, TXN, DEVICES, "device_id", ["is_rooted"], "rows ids fraud value priced"
    ).select("is_rooted", *_fraud_columns(), average("avg_txn_amount"))


@report("q5_06_high_value_fraud")
def high_value_fraud(t, fraction=0.9):
    limit = exact_percentiles(t.scan(TXN, "amount"), "amount", {"p": fraction}).scalar()
    segment = Key(
        "txn_segment", ("amount",),
        F.when(F.col("amount") >= limit, "High Value").otherwise("Normal"),
    )
    return rollup(t, TXN, [segment], "rows fraud").select(
        "txn_segment", n("rows", "txn_count"), n("fraud", "fraud_count"),
        rate("fraud", "fraud_rate_pct"),
    )


@report("q5_07_fraud_by_merchant_risk")
def fraud_by_merchant_risk(t):
    return rollup_through(
        t, TXN, MERCHANTS, "merchant_id", [risk_band("merchant_risk_band")], "rows ids fraud"
    ).select("merchant_risk_band", *_fraud_columns()).orderBy(
        desc("fraud_rate_pct"), "merchant_risk_band")


@report("q5_08_fraud_by_customer_risk")
def fraud_by_customer_risk(t):
    return rollup_through(
        t, TXN, CUSTOMERS, "customer_id", [risk_band("customer_risk_band")],
        "rows ids fraud value priced",
    ).select("customer_risk_band", *_fraud_columns(), average("avg_txn_amount")).orderBy(
        desc("fraud_rate_pct"), "customer_risk_band")


@report("q5_09_fraud_by_day_part")
def fraud_by_day_part(t, exact=False):
    """Transactions, and alerts on them, by time of day.

    A transaction with k alerts counts k times, as the left join to the alerts
    makes it; ``exact=True`` counts it once. Joined rows are counted by band and
    alert first, where those without an alert make one group per band, combined
    before they are shuffled; so transactions are shuffled once, for the join, or
    not at all where they are stored in buckets.
    """
    part = bands.below("hour(timestamp)", bands.DAY_PARTS, bands.DAY_PART_REST)
    txns = t.by_key(TXN, "transaction_id", "transaction_id", "timestamp", "fraud_flag").select(
        "transaction_id", "fraud_flag", named(part, "time_band"))
    counts = [named("count(1)", "txns"),
              named("sum(CASE WHEN fraud_flag THEN 1 ELSE 0 END)", "fraud")]
    per_alert = left_join_many(
        txns, t.by_key(ALERTS, "transaction_id", "transaction_id", "alert_id"), "transaction_id",
    ).groupBy("time_band", "alert_id").agg(*counts)
    totals = per_alert.groupBy("time_band").agg(
        named("sum(txns)", "total_txns"), named("sum(fraud)", "fraud_txns"),
        named("count(alert_id)", "fraud_alerts"))
    if exact:  # these come from the transactions alone, without their identifiers
        once = txns.groupBy("time_band").agg(*counts).select(
            named("time_band", "band"), named("txns", "total_txns"), named("fraud", "fraud_txns"))
        totals = totals.select("time_band", "fraud_alerts").join(
            once, F.expr("time_band <=> band")).drop("band")
    return totals.select(
        "time_band", "total_txns", "fraud_txns",
        rate("fraud_txns", "fraud_rate_pct", "total_txns"),
        "fraud_alerts",
    ).orderBy(desc("fraud_rate_pct"), "time_band")


@report("q5_10_riskiest_merchants")
def riskiest_merchants(t, top=10, at_least=10):
    keys = ["merchant_id", "merchant_name", "merchant_type", "region", "risk_score"]
    return (
        rollup_through(t, TXN, MERCHANTS, "merchant_id", keys, "rows ids fraud")
        .where(F.col("ids") >= at_least)
        .select(*keys, *_fraud_columns())
        .orderBy(desc("fraud_rate_pct"), *keys).limit(top)
    )


@report("q5_11_flagged_and_alerted")
def flagged_and_alerted(t):
    """Three distinct counts over transactions left-joined to alerts.

    The join does not change which transactions exist, so they are counted
    without it. ``flagged_in_both`` keeps its published name although it
    counts every transaction.
    """
    txns = (
        t.by_key(TXN, "transaction_id", "transaction_id", "fraud_flag")
        .where(F.col("transaction_id").isNotNull())
        .groupBy("transaction_id").agg(F.bool_or("fraud_flag").alias("flagged"))
    )
    alerts = t.by_key(ALERTS, "transaction_id", "transaction_id", "alert_id")
    alerted = rows_with_key_in(
        t.by_key(TXN, "transaction_id", "transaction_id"),
        alerts.select("transaction_id").distinct(), "transaction_id",
    ).distinct()
    matched = alerts.join(alerted, "transaction_id", "left_semi")
    alert_count = matched.agg(F.count_distinct("alert_id")).scalar()
    return txns.agg(
        named("count(1)", "all_txns"),
        named(f"coalesce({tally('flagged')}, 0)", "flagged"),
    ).select(
        n("all_txns", "flagged_in_both"), alert_count.alias("total_alerts"),
        n("flagged", "flagged_transactions"),
    )


@report("q5_12_fraud_by_month")
def fraud_by_month(t):
    return rollup(t, TXN, [month("timestamp", "year_month")], "rows fraud").select(
        "year_month", n("rows", "total_txns"), n("fraud", "fraud_txns"),
        rate("fraud", "fraud_rate_pct"),
    ).orderBy("year_month")
