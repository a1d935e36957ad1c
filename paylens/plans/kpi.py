"""Step 2: headline figures, one row each."""

from __future__ import annotations

from ..functions.calendar import days_before, hours_crossed
from ..functions.rates import tally, whole_div
from ..operators.rollup import rollup
from .catalog import report
from .common import (
    ALERTS, FEEDBACK, TXN, average, average_score_2dp, n, named, rate, total,
)


@report("q2_01_volume")
def volume(t):
    return rollup(t, TXN, [], "rows value priced low high").select(
        n("rows", "total_transactions"), total("total_value_inr"),
        average("avg_transaction_amount"), n("low", "min_amount"), n("high", "max_amount"),
    )


@report("q2_02_status_rates")
def status_rates(t):
    return rollup(t, TXN, [], "rows failed success pending").select(
        n("rows", "total_transactions"), n("failed", "failed_count"),
        n("success", "success_count"), n("pending", "pending_count"),
        rate("failed", "failure_rate_pct"), rate("success", "success_rate_pct"),
    )


@report("q2_03_fraud_rate")
def fraud_rate(t):
    return rollup(t, TXN, [], "rows fraud").select(
        n("rows", "total_transactions"), n("fraud", "fraud_flagged_count"),
        rate("fraud", "fraud_rate_pct"),
    )


@report("q2_04_reversal_rate")
def reversal_rate(t):
    return rollup(t, TXN, [], "rows reversed").select(
        n("reversed", "reversed_count"), rate("reversed", "reversal_rate_pct")
    )


@report("q2_05_alert_resolution")
def alert_resolution(t):
    return rollup(t, ALERTS, [], "rows resolved open").select(
        n("rows", "total_alerts"), n("resolved", "resolved_alerts"), n("open", "open_alerts"),
        rate("resolved", "resolution_rate_pct"),
    )


@report("q2_06_resolution_hours")
def resolution_hours(t):
    closed = (
        t.scan(ALERTS, "alert_date", "resolution_date", "resolved")
        .where("resolved AND resolution_date IS NOT NULL")
        .select(named(hours_crossed("alert_date", "resolution_date"), "hours"))
    )
    return closed.agg(
        named(whole_div("sum(hours)", "count(hours)"), "avg_resolution_hours"),
        named("min(hours)", "min_resolution_hours"),
        named("max(hours)", "max_resolution_hours"),
    )


@report("q2_07_retention", clock="transactions")
def retention(t, as_of=None, days=90):
    """Customers seen at all and lately; one row per customer instead of two distinct counts."""
    recent = f"timestamp >= {days_before(as_of, days)}"
    seen = (
        t.scan(TXN, "customer_id", "timestamp")
        .where("customer_id IS NOT NULL")
        .groupBy("customer_id").agg(named("max(timestamp)", "timestamp"))
        .agg(named("count(1)", "everyone"), named(f"coalesce({tally(recent)}, 0)", "lately"))
    )
    return seen.select(
        n("everyone", "total_customers"), n("lately", f"active_last_{days}_days"),
        rate("lately", "retention_rate_pct", "everyone"),
    )


@report("q2_08_satisfaction")
def satisfaction(t):
    return rollup(t, FEEDBACK, [], "rows score scored resolved").select(
        average_score_2dp("avg_satisfaction_score"), n("rows", "total_feedbacks"),
        n("resolved", "resolved_feedbacks"), rate("resolved", "feedback_resolution_rate_pct"),
    )
