"""Step 9: summaries for management (the data-quality report is with step 1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.fanout import children, copies, times as multiplied
from ..operators.ranking import change_from_previous
from ..operators.rollup import rollup, rollup_around
from .catalog import report
from .common import (
    ALERTS, CUSTOMERS, FEEDBACK, MERCHANTS, TXN, average_2dp, average_score, average_score_2dp,
    desc, month, n, named, rate, total, total_2dp,
)


@report("q9_01_executive_summary")
def executive_summary(t):
    """Six figures from one pass over the transactions, four from the other tables."""
    figures = rollup(t, TXN, [], "rows value priced failed fraud reversed")
    customers = t.scan(CUSTOMERS, "customer_id").agg(F.count(F.lit(1))).scalar()
    merchants = t.scan(MERCHANTS, "merchant_id").agg(F.count(F.lit(1))).scalar()
    score = rollup(t, FEEDBACK, [], "score scored").select(average_score_2dp("s")).scalar()
    closed = rollup(t, ALERTS, [], "rows resolved").select(rate("resolved", "r")).scalar()
    return figures.select(
        n("rows", "total_transactions"), total_2dp("total_value_inr"),
        average_2dp("avg_txn_amount"), rate("failed", "failure_rate_pct"),
        rate("fraud", "fraud_rate_pct"), rate("reversed", "reversal_rate_pct"),
        customers.alias("total_customers"), merchants.alias("total_merchants"),
        score.alias("avg_satisfaction_score"), closed.alias("fraud_alert_resolution_rate_pct"),
    )


@report("q9_02_customers_needing_action")
def customers_needing_action(t, top=20, exact=False):
    """Customers with fraud, by number of alerts and risk.

    Counts are those of the left joins customer - transaction - alert - feedback:
    a transaction counts once per alert on it, and everything once per feedback
    row. No product is built; each child is reduced first. ``exact=True`` leaves
    the multiplication out.
    """
    alerts = t.by_key(ALERTS, "transaction_id", "transaction_id", "alert_id")
    per_txn = children(alerts, "transaction_id", rows_="count(1)", alerts="count(alert_id)")
    txns = t.by_key(TXN, "transaction_id", "transaction_id", "customer_id", "fraud_flag", "status")
    txns = txns.join(per_txn, "transaction_id", "left")
    times = F.expr("1L" if exact else "coalesce(rows_, 1)")
    per_customer = children(
        txns.withColumn("times", times), "customer_id",
        txns="sum(CASE WHEN transaction_id IS NOT NULL THEN times ELSE 0 END)",
        fraud="sum(CASE WHEN fraud_flag THEN times ELSE 0 END)",
        failed="sum(CASE WHEN status = 'failed' THEN times ELSE 0 END)",
        alerts="sum(coalesce(alerts, 0))",
    ).where("fraud > 0")
    scores = children(t.scan(FEEDBACK, "customer_id", "satisfaction_score"), "customer_id",
                      feedback="count(1)", score="sum(satisfaction_score)",
                      scored="count(satisfaction_score)")
    owners = t.scan(CUSTOMERS, "customer_id", "full_name", "region", "risk_score",
                    "is_business_user")
    every = "1L" if exact else copies("feedback")
    return (
        per_customer.join(owners, "customer_id").join(scores, "customer_id", "left")
        .select("*", average_score("mean_score"))
        .groupBy(*owners.columns).agg(  # merges repeated customer rows
            *[named(multiplied(count, every), name) for count, name in (
                ("txns", "total_txns"), ("fraud", "fraud_txns"), ("failed", "failed_txns"),
                ("alerts", "fraud_alerts"))],
            named("max(mean_score)", "avg_satisfaction"),
        )
        .orderBy(desc("fraud_alerts"), desc("risk_score"), "customer_id").limit(top)
    )


@report("q9_03_region_scorecard", lookup=CUSTOMERS, on="customer_id", by="region",
        count="total_customers", risk="avg_customer_risk_score")
@report("q9_04_merchant_type_scorecard", lookup=MERCHANTS, on="merchant_id", by="merchant_type",
        count="merchant_count", risk="avg_merchant_risk_score")
def scorecard(t, lookup, on, by, count, risk):
    return rollup_around(
        t, lookup, TXN, on, [by], "rows ids value priced fraud failed",
        count_as=count, weighted={"risk_score": "risk"},
    ).select(
        by, count, n("ids", "total_txns"), total_2dp("total_amount"),
        average_2dp("avg_txn_amount"), rate("fraud", "fraud_rate_pct"),
        rate("failed", "failure_rate_pct"), F.round("risk", 4).alias(risk),
    ).orderBy(desc("total_amount"), by)


@report("q9_05_channel_scorecard")
def channel_scorecard(t):
    return rollup(t, TXN, ["channel"], "rows value fraud failed reversed").select(
        "channel", n("rows", "total_txns"), total_2dp("total_amount"),
        rate("fraud", "fraud_rate_pct"), rate("failed", "failure_rate_pct"),
        rate("reversed", "reversal_rate_pct"),
    ).orderBy(desc("total_txns"), "channel")


@report("q9_06_monthly_growth")
def monthly_growth(t):
    """The window runs over one row per calendar month."""
    monthly = rollup(t, TXN, [month("timestamp", "yr_month")], "rows value").select(
        "yr_month", n("rows", "txn_count"), total("total_amount")
    )
    return change_from_previous(
        monthly, "yr_month", "txn_count", "prev_month_txns", "mom_growth_pct"
    ).orderBy("yr_month")
