"""Labels for value ranges. The last label also takes NULL."""

from __future__ import annotations

# The labels and bounds below are part of the published results.
AGE_BANDS = ((25, "Under 25"), (35, "25-34"), (45, "35-44"), (55, "45-54"))
AGE_REST = "55+"
RISK_BANDS = ((0.7, "High Risk (0.7-1.0)"), (0.4, "Medium Risk (0.4-0.7)"))
RISK_REST = "Low Risk (0-0.4)"
DAY_PARTS = ((6, "Night (00-05)"), (12, "Morning (06-11)"), (18, "Afternoon (12-17)"))
DAY_PART_REST = "Evening (18-23)"
ACTIVITY_BANDS = ((1, "Inactive"), (6, "Low Activity (1-5)"), (21, "Medium Activity (6-20)"))
ACTIVITY_REST = "High Activity (20+)"
AGING_BANDS = ((2, "0-1 days"), (8, "2-7 days"), (31, "8-30 days"))
AGING_REST = "Over 30 days (stale)"


def _labels(value: str, test: str, steps, rest: str) -> str:
    cases = " ".join(f"WHEN {value} {test} {bound} THEN '{text}'" for bound, text in steps)
    return f"CASE {cases} ELSE '{rest}' END"


def below(value: str, steps, rest: str) -> str:
    """The label of the first step whose bound lies above the value."""
    return _labels(value, "<", steps, rest)


def at_least(value: str, steps, rest: str) -> str:
    """The label of the first step whose bound the value reaches."""
    return _labels(value, ">=", steps, rest)
