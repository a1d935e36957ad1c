"""Step 7: merchants."""

from __future__ import annotations

from ..operators import integrity
from ..operators.ranking import top_per_group
from ..operators.rollup import rollup, rollup_through
from .catalog import report
from .common import MERCHANTS, TXN, average, desc, month, n, rate, total


@report("q7_01_failures_by_region")
def failures_by_region(t):
    return rollup_through(
        t, TXN, MERCHANTS, "merchant_id", ["region"], "rows ids failed value priced"
    ).select(
        "region", n("ids", "total_txns"), n("failed", "failed_txns"),
        rate("failed", "failure_rate_pct"), average("avg_txn_amount"),
    ).orderBy(desc("failure_rate_pct"), "region")


@report("q7_02_onboarding")
def onboarding(t):
    return rollup(t, MERCHANTS, [month("onboard_date", "onboard_month")], "rows").select(
        "onboard_month", n("rows", "new_merchants")
    ).orderBy("onboard_month")


@report("q7_03_merchants_without_txns")
def merchants_without_txns(t):
    return integrity.orphans(
        t.scan(MERCHANTS, "merchant_id"), "merchant_id", t.scan(TXN, "merchant_id"),
        "merchant_id", "inactive_merchants",
    )


@report("q7_04_top_merchants_by_region")
def top_merchants_by_region(t, top=3):
    """Merchants of one name and type in a region count as one."""
    keys = ["region", "merchant_name", "merchant_type"]
    ranked = rollup_through(t, TXN, MERCHANTS, "merchant_id", keys, "ids value").select(
        *keys, n("ids", "txn_count"), total("total_amount")
    )
    return top_per_group(
        ranked, ["region"], [desc("txn_count"), "merchant_name", "merchant_type"], top
    ).orderBy("region", desc("txn_count"), "merchant_name", "merchant_type")
