"""Step 4: per-entity ratios."""

from __future__ import annotations

from ..functions.rates import joined_mean
from ..operators.rollup import MONEY_DIGITS, rollup, rollup_through
from .catalog import report
from .common import CUSTOMERS, MERCHANTS, TXN, desc, n, named, rate, renamed, total


@report("q4_01_value_per_customer")
def value_per_customer(t):
    per_txn = joined_mean("value", MONEY_DIGITS, "ids", 2)
    return rollup(t, TXN, ["customer_id"], "ids value").select(
        "customer_id", n("ids", "total_transactions"), total("total_amount"),
        named(per_txn, "txn_value_per_customer"),
    ).orderBy(desc("txn_value_per_customer"), "customer_id")


@report("q4_02_merchant_fraud_ratio")
def merchant_fraud_ratio(t):
    keys = ["merchant_id", "merchant_name", "merchant_type", "region",
            renamed("risk_score", "merchant_risk_score")]
    return rollup_through(t, TXN, MERCHANTS, "merchant_id", keys, "rows ids fraud").select(
        "merchant_id", "merchant_name", "merchant_type", "region", "merchant_risk_score",
        n("ids", "total_txns"), n("fraud", "fraud_txns"),
        rate("fraud", "merchant_fraud_ratio_pct"),
    ).orderBy(desc("merchant_fraud_ratio_pct"), "merchant_id")


@report("q4_03_device_fraud_ratio")
def device_fraud_ratio(t):
    return rollup(t, TXN, ["device_type"], "rows ids fraud").select(
        "device_type", n("ids", "total_txns"), n("fraud", "fraud_txns"),
        rate("fraud", "device_fraud_ratio_pct"),
    ).orderBy(desc("device_fraud_ratio_pct"), "device_type")


@report("q4_04_channel_failure_rate")
def channel_failure_rate(t):
    return rollup(t, TXN, ["channel"], "rows failed").select(
        "channel", n("rows", "total_txns"), n("failed", "failed_txns"),
        rate("failed", "failure_rate_pct"),
    ).orderBy(desc("failure_rate_pct"), "channel")


@report("q4_05_customer_risk_summary")
def customer_risk_summary(t):
    keys = ["customer_id", "full_name", "region", renamed("risk_score", "customer_risk_score"),
            "is_business_user"]
    return rollup_through(
        t, TXN, CUSTOMERS, "customer_id", keys, "rows ids value fraud failed"
    ).select(
        "customer_id", "full_name", "region", "customer_risk_score", "is_business_user",
        n("ids", "total_txns"), total("total_amount"), n("fraud", "fraud_txns"),
        n("failed", "failed_txns"), rate("fraud", "fraud_rate_pct"),
        rate("failed", "failure_rate_pct"),
    ).orderBy(desc("fraud_rate_pct"), "customer_id")
