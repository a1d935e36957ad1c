"""Calendar arithmetic on timestamps without a time zone."""

from __future__ import annotations

from datetime import datetime

# English weekday names, Sunday being day 1.
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def clock(as_of: datetime | str | None) -> str:
    """The moment a report is made for; the current time unless given."""
    if as_of is None:
        return "CAST(current_timestamp() AS TIMESTAMP_NTZ)"
    return f"CAST('{datetime.fromisoformat(str(as_of))}' AS TIMESTAMP_NTZ)"


def days_before(as_of, days: int) -> str:
    return f"({clock(as_of)} - INTERVAL {int(days)} DAYS)"


def months_before(as_of, months: int) -> str:
    """Clamped to the end of the month and keeping the time of day."""
    return f"({clock(as_of)} - INTERVAL {int(months)} MONTHS)"


def _hour_number(moment: str) -> str:
    return f"(CAST(unix_date(to_date({moment})) AS BIGINT) * 24 + hour({moment}))"


def hours_crossed(start: str, end: str) -> str:
    """Full hours on the clock passed between two moments (00:59 to 01:01 is one)."""
    return f"({_hour_number(end)} - {_hour_number(start)})"


def days_crossed(start: str, end: str) -> str:
    return f"datediff(to_date({end}), to_date({start}))"


def month_number(moment: str) -> str:
    """An integer per calendar month: cheaper to group by than its text."""
    return f"(year({moment}) * 12 + month({moment}) - 1)"


def month_text(number: str) -> str:
    return f"format_string('%04d-%02d', CAST({number} div 12 AS INT), {number} % 12 + 1)"


def weekday_name(number: str) -> str:
    names = ", ".join(f"'{day}'" for day in WEEKDAYS)
    return f"element_at(array({names}), {number})"
