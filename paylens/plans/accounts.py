"""Step 11: accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.rollup import Where, rollup, rollup_through
from ..operators.shares import with_share
from ..operators.text import joined_text
from .catalog import report
from .common import ACCOUNTS, TXN, average_2dp, desc, n, rate, total_2dp


@report("q11_01_accounts_by_status")
def accounts_by_status(t):
    counted = rollup(t, ACCOUNTS, ["status"], "rows").withColumnRenamed("rows", "account_count")
    return with_share(counted, "account_count")


@report("q11_02_activity_on_closed_accounts")
def activity_on_closed_accounts(t, states=("blocked", "suspended")):
    listed = ", ".join(f"'{state}'" for state in states)
    closed = Where(("status",), f"status IN ({listed})")
    keys = ["upi_id", "customer_id", "bank_name", "account_type", "status"]
    return rollup_through(
        t, TXN, ACCOUNTS, "upi_id", keys, "ids latest", lookup_where=closed
    ).select(
        *keys, n("ids", "txn_count_on_inactive_account"), n("latest", "last_txn_date")
    ).orderBy(desc("txn_count_on_inactive_account"), "upi_id")


@report("q11_03_customers_with_several_accounts")
def customers_with_several_accounts(t):
    return joined_text(
        t.scan(ACCOUNTS, "customer_id", "upi_id", "bank_name"),
        "customer_id", "upi_id", "upi_count", "bank_name", "banks", ", ",
    ).where(F.col("upi_count") > 1).orderBy(desc("upi_count"), "customer_id")


@report("q11_04_txns_by_bank")
def txns_by_bank(t):
    return rollup_through(
        t, TXN, ACCOUNTS, "upi_id", ["bank_name"], "rows ids value fraud failed"
    ).select(
        "bank_name", n("ids", "total_txns"), total_2dp("total_amount"), n("fraud", "fraud_txns"),
        rate("fraud", "fraud_rate_pct"), rate("failed", "failure_rate_pct"),
    ).orderBy(desc("total_txns"), "bank_name")


@report("q11_05_txns_by_account_type")
def txns_by_account_type(t):
    return rollup_through(
        t, TXN, ACCOUNTS, "upi_id", ["account_type"], "rows ids value priced fraud"
    ).select(
        "account_type", n("ids", "total_txns"), average_2dp("avg_txn_amount"),
        n("fraud", "fraud_txns"), rate("fraud", "fraud_rate_pct"),
    ).orderBy(desc("total_txns"), "account_type")
