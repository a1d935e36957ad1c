"""Step 6: customer behaviour."""

from __future__ import annotations

from ..functions import bands
from ..functions.calendar import months_before
from ..functions.rates import mean, whole_div
from ..operators import integrity
from ..operators.joins import small
from ..operators.rollup import Key, rollup, rollup_around
from .catalog import report
from .common import (
    CUSTOMERS, FEEDBACK, TXN, VALUE, average, average_score, desc, n, named, rate, total,
)


@report("q6_01_business_vs_regular")
def business_vs_regular(t):
    return rollup_around(
        t, CUSTOMERS, TXN, "customer_id", ["is_business_user"], "rows ids value priced fraud",
        count_as="customer_count",
    ).select(
        "is_business_user", "customer_count", n("ids", "total_txns"), total("total_amount"),
        average("avg_txn_amount"), n("fraud", "fraud_txns"), rate("fraud", "fraud_rate_pct"),
    )


@report("q6_02_activity_segments")
def activity_segments(t):
    """One row per customer, then one per segment; money stays exact on both levels."""
    segment = bands.below("ids", bands.ACTIVITY_BANDS, bands.ACTIVITY_REST)
    per_customer = rollup(t, TXN, ["customer_id"], "ids value")
    grouped = per_customer.groupBy(named(segment, "activity_segment")).agg(
        named("count(1)", "customer_count"), named("sum(ids)", "ids"),
        *[named(f"sum({part})", part) for part in ("value_hi", "value_lo", "value_rest")],
        named("count(value_hi)", "valued"),
    )
    return grouped.select(
        "activity_segment", "customer_count",
        named(whole_div("ids", "customer_count"), "avg_txns"),
        named(mean(VALUE, "valued"), "avg_total_amount"),
    ).orderBy("avg_txns", "activity_segment")


@report("q6_03_customers_without_txns")
def customers_without_txns(t):
    return integrity.orphans(
        t.scan(CUSTOMERS, "customer_id"), "customer_id", t.scan(TXN, "customer_id"),
        "customer_id", "customers_with_no_transactions",
    )


@report("q6_04_new_vs_existing", clock="transactions")
def new_vs_existing(t, as_of=None, months=6):
    kind = Key(
        "customer_type", ("date_joined",),
        f"CASE WHEN date_joined >= {months_before(as_of, months)} THEN 'New Customer'"
        " ELSE 'Existing Customer' END",
    )
    return rollup_around(
        t, CUSTOMERS, TXN, "customer_id", [kind], "rows ids value priced fraud",
        count_as="customer_count",
    ).select(
        "customer_type", "customer_count", n("ids", "total_txns"), average("avg_txn_amount"),
        rate("fraud", "fraud_rate_pct"),
    )


@report("q6_05_feedback_by_issue")
def feedback_by_issue(t):
    return rollup(t, FEEDBACK, ["issue_type"], "rows score scored resolved").select(
        "issue_type", n("rows", "feedback_count"), average_score("avg_satisfaction"),
        n("resolved", "resolved_count"), rate("resolved", "resolution_rate_pct"),
    ).orderBy(desc("feedback_count"), "issue_type")


@report("q6_06_unhappy_customers")
def unhappy_customers(t, worst=2):
    bad = t.scan(
        FEEDBACK, "feedback_id", "customer_id", "issue_type", "satisfaction_score", "resolved",
        "date_submitted",
    ).where(f"satisfaction_score <= {int(worst)} AND NOT resolved")
    owners = t.scan(CUSTOMERS, "customer_id", "full_name", "region")
    return bad.join(small(owners), "customer_id").orderBy(desc("date_submitted"), "feedback_id").select(
        "customer_id", "full_name", "region", "issue_type", "satisfaction_score", "resolved",
        "date_submitted",
    )
