"""Step 15: feedback."""

from __future__ import annotations

from ..functions.calendar import clock, days_before, days_crossed
from ..operators.joins import small
from ..operators.rollup import rollup, rollup_through
from .catalog import report
from .common import CUSTOMERS, FEEDBACK, average_score_2dp, desc, month, n, named, rate


@report("q15_01_score_by_month")
def score_by_month(t):
    return rollup(
        t, FEEDBACK, [month("date_submitted", "year_month")], "rows score scored low high"
    ).select(
        "year_month", n("rows", "feedback_count"), average_score_2dp("avg_satisfaction"),
        n("low", "low_score_count"), n("high", "high_score_count"),
    ).orderBy("year_month")


@report("q15_02_score_by_region")
def score_by_region(t):
    return rollup_through(
        t, FEEDBACK, CUSTOMERS, "customer_id", ["region"], "ids score scored open"
    ).select(
        "region", n("ids", "feedback_count"), average_score_2dp("avg_satisfaction"),
        n("open", "unresolved_issues"),
    ).orderBy("avg_satisfaction", "region")


@report("q15_03_overdue_issues", clock="feedback")
def overdue_issues(t, as_of=None, days=30):
    end = days_before(as_of, days)
    late = t.within(FEEDBACK, "date_submitted", until=end).scan(
        FEEDBACK, "feedback_id", "customer_id", "issue_type", "satisfaction_score",
        "date_submitted", "resolved",
    ).where(f"NOT resolved AND date_submitted < {end}")
    age = days_crossed("date_submitted", clock(as_of))
    owners = t.scan(CUSTOMERS, "customer_id", "full_name")
    return late.join(small(owners), "customer_id").select(
        "feedback_id", "customer_id", "full_name", "issue_type", "satisfaction_score",
        "date_submitted", named(age, "days_open"),
    ).orderBy(desc("days_open"), "feedback_id")


@report("q15_04_resolution_by_issue")
def resolution_by_issue(t):
    return rollup(t, FEEDBACK, ["issue_type"], "rows resolved score scored").select(
        "issue_type", n("rows", "total_issues"), n("resolved", "resolved_count"),
        rate("resolved", "resolution_rate_pct"), average_score_2dp("avg_satisfaction"),
    ).orderBy("resolution_rate_pct", "issue_type")
