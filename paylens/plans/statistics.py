"""Step 14: inputs for statistical tests."""

from __future__ import annotations

from ..functions.rates import mean, ratio, rounded
from ..operators.percentiles import exact_percentiles
from ..operators.rollup import rollup, rollup_around, rollup_through
from .catalog import report
from .common import CUSTOMERS, DEVICES, MERCHANTS, TXN, average_2dp, desc, n, named, rate


def _two_places(column, name):
    return named(rounded(column), name)


@report("q14_01_amount_by_device_type")
def amount_by_device_type(t):
    return rollup(t, TXN, ["device_type"], "rows value priced low high spread").select(
        "device_type", n("rows", "txn_count"), average_2dp("mean_amount"),
        _two_places("low", "min_amount"), _two_places("high", "max_amount"),
        _two_places("spread", "std_dev_amount"),
    ).orderBy(desc("mean_amount"), "device_type")


@report("q14_02_amount_by_region")
def amount_by_region(t):
    return rollup_through(
        t, TXN, CUSTOMERS, "customer_id", ["region"], "ids value priced spread low high"
    ).select(
        "region", n("ids", "txn_count"), average_2dp("mean_amount"),
        _two_places("spread", "std_dev_amount"), _two_places("low", "min_amount"),
        _two_places("high", "max_amount"),
    ).orderBy(desc("mean_amount"), "region")


@report("q14_03_fraud_by_merchant_type")
def fraud_by_merchant_type(t):
    """The standard deviation of a 0/1 flag follows from its counts."""
    flags = "(fraud + clean)"
    share = mean("fraud", flags)
    variance = f"{share} * (1 - {share}) * {flags} / nullif({flags} - 1, 0)"
    return rollup_through(
        t, TXN, MERCHANTS, "merchant_id", ["merchant_type"], "rows ids fraud clean"
    ).select(
        "merchant_type", n("ids", "txn_count"), n("fraud", "fraud_count"),
        rate("fraud", "fraud_rate_pct"), named(ratio("fraud", flags, 4), "fraud_mean"),
        named(rounded(f"sqrt({variance})", 4), "fraud_std_dev"),
    ).orderBy(desc("fraud_rate_pct"), "merchant_type")


@report("q14_04_channel_by_fraud")
def channel_by_fraud(t):
    return rollup(t, TXN, ["channel"], "rows fraud clean").select(
        "channel", n("fraud", "fraud_yes"), n("clean", "fraud_no"), n("rows", "total")
    ).orderBy("channel")


@report("q14_05_device_type_by_status")
def device_type_by_status(t):
    return rollup(t, TXN, ["device_type"], "rows success failed pending").select(
        "device_type", n("success", "success_count"), n("failed", "failed_count"),
        n("pending", "pending_count"), n("rows", "total"),
    ).orderBy("device_type")


@report("q14_06_customer_fraud_rate")
def customer_fraud_rate(t):
    return rollup_around(
        t, CUSTOMERS, TXN, "customer_id", ["customer_id", "risk_score"], "ids fraud"
    ).select(
        "customer_id", "risk_score", n("ids", "txn_count"), n("fraud", "fraud_txns"),
        rate("fraud", "individual_fraud_rate_pct", "ids"),
    ).orderBy(desc("risk_score"), "customer_id")


@report("q14_07_rooted_comparison")
def rooted_comparison(t):
    return rollup_through(
        t, TXN, DEVICES, "device_id", ["is_rooted"], "rows ids fraud value priced spread"
    ).select(
        "is_rooted", n("ids", "txn_count"), n("fraud", "fraud_count"),
        rate("fraud", "fraud_rate_pct"), average_2dp("avg_amount"),
        _two_places("spread", "std_dev_amount"),
    )


# Published column names and fractions.
PERCENTILES = {"p25": 0.25, "p50_median": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95,
               "p99": 0.99}


@report("q14_08_amount_percentiles")
def amount_percentiles(t, fractions=None):
    wanted = fractions or PERCENTILES
    values = exact_percentiles(t.scan(TXN, "amount"), "amount", wanted)
    return values.select(*[_two_places(name, name) for name in wanted])
