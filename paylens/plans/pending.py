"""Step 13: pending transactions."""

from __future__ import annotations

from ..functions import bands
from ..functions.calendar import clock, days_crossed
from ..operators.rollup import Key, rollup, rollup_through
from .catalog import report
from .common import CUSTOMERS, TXN, desc, n, status_is, total_2dp


@report("q13_01_pending_by_age", clock="transactions")
def pending_by_age(t, as_of=None):
    """A timestamp after the clock has a negative age and falls in the first bucket."""
    bucket = Key(
        "aging_bucket", ("timestamp",),
        bands.below(days_crossed("timestamp", clock(as_of)), bands.AGING_BANDS,
                    bands.AGING_REST),
    )
    return rollup(t, TXN, [bucket], "rows value", status_is("pending")).select(
        "aging_bucket", n("rows", "pending_count"), total_2dp("total_amount_at_risk")
    ).orderBy(desc("pending_count"), "aging_bucket")


@report("q13_02_largest_pending")
def largest_pending(t, top=10):
    keys = ["customer_id", "full_name", "region"]
    return rollup_through(
        t, TXN, CUSTOMERS, "customer_id", keys, "ids value", where=status_is("pending")
    ).select(
        *keys, n("ids", "pending_txns"), total_2dp("total_pending_amount")
    ).orderBy(desc("total_pending_amount"), *keys).limit(top)
