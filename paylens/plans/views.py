"""Step 16: the dashboard views."""

from __future__ import annotations

from ..functions.rates import rounded, split_sum, tally
from ..operators.fanout import children, copies, times as multiplied
from ..operators.joins import left_join_many, left_lookup, small
from ..operators.rollup import MONEY_DIGITS, rollup_through
from ..operators.sizing import WIDE
from .catalog import report
from .common import (
    ACCOUNTS, ALERTS, CUSTOMERS, DEVICES, FEEDBACK, MERCHANTS, TXN, VALUE, average_2dp,
    average_score_2dp, month, n, named, rate, total_2dp,
)


KPI_KEYS = (month("timestamp", "year_month"), "channel", "device_type", "transaction_type")
KPI_FACETS = "rows ids value priced fraud failed reversed"


def kpi_shares(t):
    """The counts and sums of the KPI view, which add up over parts of the transactions."""
    return rollup_through(
        t, TXN, CUSTOMERS, "customer_id", ["region"], KPI_FACETS, fact_keys=KPI_KEYS,
        reduce_first=False,
    )


def kpi_columns(shares):
    return shares.select(
        "year_month", "region", "channel", "device_type", "transaction_type",
        n("ids", "total_txns"), total_2dp("total_amount"), average_2dp("avg_amount"),
        n("fraud", "fraud_count"), n("failed", "failed_count"), n("reversed", "reversal_count"),
        rate("fraud", "fraud_rate_pct"), rate("failed", "failure_rate_pct"),
    )


@report("q16_01_vw_executive_kpis")
def executive_kpis(t):
    """Grouped too finely to gain from reducing per customer first."""
    return kpi_columns(kpi_shares(t))


@report("q16_02_vw_fraud_analyst")
def fraud_analyst(t):
    """One row per transaction and alert, with its customer, device and merchant.

    The alerts come first: they lie with the transactions where both are stored in buckets.
    """
    txns = t.by_key(
        TXN, "transaction_id", "transaction_id", "customer_id", "device_id", "merchant_id",
        "amount", "transaction_type", "channel", "device_type", "status", "fraud_flag", "reversal_flag",
        "timestamp",
    )
    owners = t.scan(CUSTOMERS, "customer_id", "full_name", "region", "risk_score")
    owners = owners.withColumnRenamed("risk_score", "customer_risk_score")
    devices = t.scan(DEVICES, "device_id", "is_rooted")
    alerts = t.by_key(ALERTS, "transaction_id", "transaction_id", "alert_id", "alert_type",
                      "resolved", "alert_date")
    alerts = alerts.withColumnRenamed("resolved", "alert_resolved")
    shops = t.scan(MERCHANTS, "merchant_id", "merchant_name", "merchant_type", "risk_score")
    shops = shops.withColumnRenamed("risk_score", "merchant_risk_score")
    rows = left_join_many(txns, alerts, "transaction_id")
    rows = rows.join(small(owners, WIDE), "customer_id").join(small(devices, WIDE), "device_id")
    return left_lookup(rows, shops, "merchant_id", spread_by="transaction_id").select(
        "transaction_id", "customer_id", "full_name", "region", "customer_risk_score", "amount",
        "transaction_type", "channel", "device_type", "is_rooted", "status", "fraud_flag",
        "reversal_flag", "timestamp", "alert_id", "alert_type", "alert_resolved", "alert_date",
        "merchant_name", "merchant_type", "merchant_risk_score",
    )


_VALUE_PARTS = split_sum("amount", "value", MONEY_DIGITS)


def per_customer(t):
    """What the customer view needs of the transactions; it adds up over parts of them."""
    return children(
        t.scan(TXN, "customer_id", "transaction_id", "amount", "fraud_flag", "status",
               "timestamp"),
        "customer_id", txns="count(transaction_id)", priced="count(amount)",
        fraud=tally("fraud_flag"), failed=tally("status = 'failed'"), latest="max(timestamp)",
        **_VALUE_PARTS,
    )


def merged_per_customer(shares):
    """One row per customer from several parts of the transactions."""
    sums = ("txns", "priced", "fraud", "failed", *_VALUE_PARTS)
    return children(shares, "customer_id", latest="max(latest)",
                    **{name: f"sum({name})" for name in sums})


@report("q16_03_vw_customer_360")
def customer_360(t, exact=False, txns=None):
    """A customer's accounts, devices, transactions and feedback on one row.

    Counts and sums of transactions are those of the joined rows, that is
    multiplied by the numbers of accounts, devices and feedback rows; averages
    and distinct counts are not affected. Each child is reduced to one row per
    customer, so the product is never built. ``exact=True`` leaves the
    multiplication out. ``txns``: the transactions per customer, if they are known.
    """
    owners = t.scan(CUSTOMERS, "customer_id", "full_name", "age", "gender", "region",
                    "date_joined", "is_business_user", "risk_score")
    accounts = children(t.scan(ACCOUNTS, "customer_id", "upi_id"), "customer_id",
                        account_rows="count(1)", accounts="count(DISTINCT upi_id)")
    devices = children(t.scan(DEVICES, "customer_id", "device_id"), "customer_id",
                       device_rows="count(1)", devices="count(DISTINCT device_id)")
    feedback = children(t.scan(FEEDBACK, "customer_id", "satisfaction_score"), "customer_id",
                        feedback_rows="count(1)", score="sum(satisfaction_score)",
                        scored="count(satisfaction_score)")
    txns = per_customer(t) if txns is None else txns
    times = "1L" if exact else copies("account_rows", "device_rows", "feedback_rows")
    joined_up = owners
    for child in (accounts, devices, txns, feedback):
        joined_up = joined_up.join(child, "customer_id", "left")

    def counted(column, name):
        return named(multiplied(column, times), name)

    # Merges repeated customer rows; the rows of a customer are already together.
    with_means = joined_up.select(
        "*", average_2dp("mean_amount"), average_score_2dp("mean_score")
    )
    return with_means.groupBy(*owners.columns).agg(
        named("coalesce(max(accounts), 0)", "upi_account_count"),
        named("coalesce(max(devices), 0)", "device_count"),
        counted("txns", "total_txns"),
        named(rounded(f"sum({VALUE} * {times})"), "total_txn_amount"),
        named("max(mean_amount)", "avg_txn_amount"),
        counted("fraud", "fraud_txns"),
        counted("failed", "failed_txns"),
        named("max(mean_score)", "avg_satisfaction_score"),
        named("max(latest)", "last_transaction_date"),
    )


VIEWS = {
    "vw_executive_kpis": executive_kpis,
    "vw_fraud_analyst": fraud_analyst,
    "vw_customer_360": customer_360,
}


def register_views(t) -> None:
    """Create the three views for ``spark.sql``; they are evaluated when queried."""
    for name, build in VIEWS.items():
        build(t).createOrReplaceTempView(name)


def write_views(t, folder: str) -> None:
    """Store the views as Parquet; the KPI view by month, for dashboards to prune."""
    for name, build in VIEWS.items():
        df = build(t)
        if name == "vw_executive_kpis":
            df = df.hint("rebalance", "year_month")
            df.write.mode("overwrite").partitionBy("year_month").parquet(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
