"""Keys, filters and output columns that many reports share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bands, calendar
from ..functions.rates import joined, joined_mean, mean, pct, ratio, rounded
from ..operators.rollup import MONEY_DIGITS, SCORE_DIGITS, Key, Where

TXN = "transaction_history"
CUSTOMERS = "customer_details"
MERCHANTS = "merchant"
DEVICES = "device_info"
ACCOUNTS = "account_details"
FEEDBACK = "customer_feedback"
ALERTS = "fraud_alert"

VALUE = joined("value", MONEY_DIGITS)


def month(column: str, name: str) -> Key:
    return Key(name, (column,), calendar.month_number(column), calendar.month_text(name))


def age_band(name: str) -> Key:
    return Key(name, ("age",), bands.below("age", bands.AGE_BANDS, bands.AGE_REST))


def risk_band(name: str) -> Key:
    return Key(name, ("risk_score",),
               bands.at_least("risk_score", bands.RISK_BANDS, bands.RISK_REST))


def renamed(column: str, name: str) -> Key:
    return Key(name, (column,), column)


def status_is(value: str) -> Where:
    return Where(("status",), f"status = '{value}'")


def named(sql: str, name: str) -> Column:
    return F.expr(f"{sql} AS {name}")


def n(facet: str, name: str) -> Column:
    return named(facet, name)


def rate(part: str, name: str, whole: str = "rows") -> Column:
    return named(pct(part, whole), name)


def total(name: str) -> Column:
    """Sum of amount."""
    return named(VALUE, name)


def total_2dp(name: str) -> Column:
    return named(rounded(VALUE), name)


def average(name: str) -> Column:
    """Average amount."""
    return named(mean(VALUE, "priced"), name)


def average_2dp(name: str) -> Column:
    return named(joined_mean("value", MONEY_DIGITS, "priced", 2), name)


def average_risk(name: str) -> Column:
    return named(mean(joined("risk", SCORE_DIGITS), "risked"), name)


def average_score(name: str) -> Column:
    return named(mean("score", "scored"), name)


def average_score_2dp(name: str) -> Column:
    return named(ratio("score", "scored", 2), name)


def desc(column: str) -> Column:
    return F.col(column).desc()
