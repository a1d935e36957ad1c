"""Step 12: reversals."""

from __future__ import annotations

from ..operators.rollup import Where, rollup, rollup_through
from .catalog import report
from .common import MERCHANTS, TXN, desc, month, n, rate, total_2dp


@report("q12_01_reversals_by_type", by="transaction_type")
@report("q12_02_reversals_by_channel", by="channel")
def reversals_by(t, by):
    return rollup(t, TXN, [by], "rows reversed").select(
        by, n("rows", "total_txns"), n("reversed", "reversed_txns"),
        rate("reversed", "reversal_rate_pct"),
    ).orderBy(desc("reversal_rate_pct"), by)


@report("q12_03_reversals_by_merchant_type")
def reversals_by_merchant_type(t):
    return rollup_through(
        t, TXN, MERCHANTS, "merchant_id", ["merchant_type"], "rows ids reversed"
    ).select(
        "merchant_type", n("ids", "total_txns"), n("reversed", "reversed_txns"),
        rate("reversed", "reversal_rate_pct"),
    ).orderBy(desc("reversal_rate_pct"), "merchant_type")


@report("q12_04_reversed_and_fraud")
def reversed_and_fraud(t):
    both = Where(("reversal_flag", "fraud_flag"), "reversal_flag AND fraud_flag")
    return rollup(t, TXN, [], "rows value", both).select(
        n("rows", "reversed_and_fraud_count"), total_2dp("total_amount_at_risk")
    )


@report("q12_05_reversals_by_month")
def reversals_by_month(t):
    return rollup(t, TXN, [month("timestamp", "year_month")], "rows reversed").select(
        "year_month", n("rows", "total_txns"), n("reversed", "reversed_txns"),
        rate("reversed", "reversal_rate_pct"),
    ).orderBy("year_month")
