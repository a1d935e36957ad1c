"""Step 3: descriptive breakdowns, and the two opening look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import days_before, weekday_name
from ..functions.rates import whole_div
from ..operators.percentiles import exact_percentiles
from ..operators.rollup import Key, Where, rollup, rollup_through
from ..operators.shares import with_share
from .catalog import report
from .common import (
    ACCOUNTS, CUSTOMERS, MERCHANTS, TXN, age_band, average, average_risk, desc, month, n, named,
    rate, total,
)


@report("p1_p90_amount")
def p90_amount(t, fraction=0.9):
    return exact_percentiles(t.scan(TXN, "amount"), "amount", {"p90_amount": fraction})


@report("p2_top_merchant_ids")
def top_merchant_ids(t, top=10):
    """The NULL merchant is a group like any other."""
    return (
        rollup(t, TXN, ["merchant_id"], "rows")
        .select("merchant_id", n("rows", "txn_count"))
        .orderBy(desc("txn_count"), F.col("merchant_id").asc_nulls_first()).limit(top)
    )


@report("q3_01_by_transaction_type")
def by_transaction_type(t):
    return rollup(t, TXN, ["transaction_type"], "rows value priced low high").select(
        "transaction_type", n("rows", "txn_count"), total("total_amount"),
        average("avg_amount"), n("low", "min_amount"), n("high", "max_amount"),
    ).orderBy(desc("txn_count"), "transaction_type")


@report("q3_02_by_type_and_status")
def by_type_and_status(t):
    return rollup(t, TXN, ["transaction_type", "status"], "rows value").select(
        "transaction_type", "status", n("rows", "txn_count"), total("total_amount"),
    ).orderBy("transaction_type", "status")


@report("q3_03_monthly_trend")
def monthly_trend(t):
    return rollup(t, TXN, [month("timestamp", "year_month")], "rows value fraud failed").select(
        "year_month", n("rows", "txn_count"), total("total_amount"),
        n("fraud", "fraud_count"), n("failed", "failed_count"),
    ).orderBy("year_month")


@report("q3_04_daily_volume", clock="transactions")
def daily_volume(t, as_of=None, days=30):
    day = Key("txn_date", ("timestamp",), "to_date(timestamp)")
    begin = days_before(as_of, days)
    recent = Where(("timestamp",), f"timestamp >= {begin}")
    t = t.within(TXN, "timestamp", since=begin)
    return rollup(t, TXN, [day], "rows value", recent).select(
        "txn_date", n("rows", "txn_count"), total("total_amount")
    ).orderBy("txn_date")


@report("q3_05_by_channel")
def by_channel(t):
    grouped = rollup(t, TXN, ["channel"], "rows value failed")
    return with_share(grouped, "rows").select(
        "channel", n("rows", "txn_count"), total("total_amount"), "pct_share",
        n("failed", "failed_count"), rate("failed", "failure_rate_pct"),
    ).orderBy(desc("txn_count"), "channel")


@report("q3_06_by_device_type")
def by_device_type(t):
    return rollup(t, TXN, ["device_type"], "rows value fraud failed").select(
        "device_type", n("rows", "txn_count"), total("total_amount"), n("fraud", "fraud_count"),
        rate("fraud", "fraud_rate_pct"), rate("failed", "failure_rate_pct"),
    ).orderBy(desc("txn_count"), "device_type")


@report("q3_07_by_region")
def by_region(t):
    return rollup_through(
        t, TXN, CUSTOMERS, "customer_id", ["region"], "rows ids value priced fraud failed"
    ).select(
        "region", n("ids", "txn_count"), total("total_amount"), average("avg_amount"),
        n("fraud", "fraud_count"), rate("fraud", "fraud_rate_pct"),
        rate("failed", "failure_rate_pct"),
    ).orderBy(desc("txn_count"), "region")


@report("q3_08_by_merchant_type")
def by_merchant_type(t):
    return rollup_through(
        t, TXN, MERCHANTS, "merchant_id", ["merchant_type"],
        "rows ids value priced fraud failed", distinct_as="active_merchants",
    ).select(
        "merchant_type", "active_merchants", n("ids", "txn_count"), total("total_amount"),
        average("avg_amount"), n("fraud", "fraud_count"), rate("fraud", "fraud_rate_pct"),
        rate("failed", "failure_rate_pct"),
    ).orderBy(desc("txn_count"), "merchant_type")


@report("q3_09_top_merchants")
def top_merchants(t, top=10):
    keys = ["merchant_id", "merchant_name", "merchant_type", "region"]
    return rollup_through(t, TXN, MERCHANTS, "merchant_id", keys, "ids value").select(
        *keys, n("ids", "txn_count"), total("total_amount")
    ).orderBy(desc("txn_count"), *keys).limit(top)


@report("q3_10_top_customers")
def top_customers(t, top=10):
    keys = ["customer_id", "full_name", "region"]
    return rollup_through(t, TXN, CUSTOMERS, "customer_id", keys, "ids value priced").select(
        *keys, n("ids", "txn_count"), total("total_amount"), average("avg_amount")
    ).orderBy(desc("total_amount"), *keys).limit(top)


@report("q3_11_customers_by_gender")
def customers_by_gender(t):
    return rollup(t, CUSTOMERS, ["gender"], "rows ages aged risk risked business").select(
        "gender", n("rows", "customer_count"), named(whole_div("ages", "aged"), "avg_age"),
        average_risk("avg_risk_score"), n("business", "business_users"),
    )


@report("q3_12_customers_by_age")
def customers_by_age(t):
    return rollup(t, CUSTOMERS, [age_band("age_group")], "rows risk risked").select(
        "age_group", n("rows", "customer_count"), average_risk("avg_risk_score")
    ).orderBy("age_group")


@report("q3_13_accounts_by_type", by="account_type")
@report("q3_14_accounts_by_bank", by="bank_name")
def accounts_by(t, by):
    counted = rollup(t, ACCOUNTS, [by], "rows").withColumnRenamed("rows", "account_count")
    return with_share(counted, "account_count").orderBy(desc("account_count"), by)


@report("q3_15_failure_reasons")
def failure_reasons(t):
    explained = Where(
        ("status", "failure_reason"),
        "status = 'failed' AND failure_reason IS NOT NULL",
    )
    counted = rollup(t, TXN, ["failure_reason"], "rows", explained)
    counted = counted.withColumnRenamed("rows", "failure_count")
    return with_share(counted, "failure_count").orderBy(desc("failure_count"), "failure_reason")


@report("q3_16_by_hour")
def by_hour(t):
    hour = Key("hour_of_day", ("timestamp",), "hour(timestamp)")
    return rollup(t, TXN, [hour], "rows fraud failed").select(
        "hour_of_day", n("rows", "txn_count"), n("fraud", "fraud_count"),
        n("failed", "failed_count"),
    ).orderBy("hour_of_day")


@report("q3_17_by_weekday")
def by_weekday(t):
    day = Key("day_num", ("timestamp",), "dayofweek(timestamp)")
    return rollup(t, TXN, [day], "rows value").select(
        named(weekday_name("day_num"), "day_of_week"), "day_num",
        n("rows", "txn_count"), total("total_amount"),
    ).orderBy("day_num")
