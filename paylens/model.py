"""The seven tables: columns, keys, references and value rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    required: bool = True
    width: int | None = None  # longest allowed text
    default: object = None  # stands in for a missing value on load
    lenient: bool = False  # an unreadable raw value becomes NULL


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    sql: str  # true when the row is fine; NULL counts as fine


@dataclass(frozen=True)
class Reference:
    column: str
    parent: str
    parent_key: str


@dataclass(frozen=True)
class Table:
    name: str
    raw_name: str  # file stem of the incoming CSV
    key: str
    columns: tuple[Column, ...]
    rules: tuple[Rule, ...] = ()
    references: tuple[Reference, ...] = ()
    free_text: bool = False  # quoted line breaks may occur inside a field
    order: str | None = None  # a date or moment by which stored files are divided
    bucket_by: str | None = None  # a column that large tables are joined by, as stored

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, True) for c in self.columns])


def _text(name, width, **kw):
    return Column(name, T.StringType(), width=width, **kw)


def _int(name):
    return Column(name, T.IntegerType())


def _double(name):
    return Column(name, T.DoubleType())


def _date(name):
    return Column(name, T.DateType())


def _moment(name, **kw):
    return Column(name, T.TimestampNTZType(), **kw)


def _flag(name):
    return Column(name, T.BooleanType(), default=False)


_RISK = Rule("risk_score within 0 and 1", "risk_score", "risk_score >= 0 AND risk_score <= 1")
_TO_CUSTOMER = Reference("customer_id", "customer_details", "customer_id")

_ALL = (
    Table(
        "customer_details", "customer_master", "customer_id",
        (
            _text("customer_id", 50), _text("full_name", 200), _text("mobile_number", 20),
            _int("age"), _text("gender", 20), _text("region", 50), _date("date_joined"),
            _flag("is_business_user"), _double("risk_score"),
        ),
        rules=(Rule("age between 1 and 119", "age", "age > 0 AND age < 120"), _RISK),
    ),
    Table(
        "customer_feedback", "customer_feedback_surveys", "feedback_id",
        (
            _text("feedback_id", 50), _text("customer_id", 50), _date("date_submitted"),
            _text("feedback_text", 500, required=False), _int("satisfaction_score"),
            _text("issue_type", 50), _flag("resolved"),
        ),
        rules=(Rule("satisfaction_score between 1 and 5", "satisfaction_score",
                    "satisfaction_score BETWEEN 1 AND 5"),),
        references=(_TO_CUSTOMER,),
        free_text=True,
        order="date_submitted",
    ),
    Table(
        "device_info", "device_info", "device_id",
        (
            _text("device_id", 50), _text("customer_id", 50), _text("device_type", 50),
            _text("app_version", 20), _flag("is_rooted"), _moment("last_active"),
        ),
        references=(_TO_CUSTOMER,),
        order="last_active",
    ),
    Table(
        "fraud_alert", "fraud_alert_history", "alert_id",
        (
            _text("alert_id", 50), _text("transaction_id", 50), _text("alert_type", 50),
            _moment("alert_date"), _flag("resolved"),
            _moment("resolution_date", required=False, lenient=True),
            _text("remarks", 500, required=False),
        ),
        references=(Reference("transaction_id", "transaction_history", "transaction_id"),),
        free_text=True,
        bucket_by="transaction_id",
    ),
    Table(
        "merchant", "merchant_info", "merchant_id",
        (
            _text("merchant_id", 50), _text("merchant_name", 200), _text("merchant_type", 50),
            _text("region", 50), _date("onboard_date"), _double("risk_score"),
        ),
        rules=(_RISK,),
    ),
    Table(
        "account_details", "upi_account_details", "upi_id",
        (
            _text("upi_id", 50), _text("customer_id", 50), _text("bank_name", 50),
            _text("account_type", 50), _date("date_added"), _text("status", 20),
        ),
        rules=(Rule("known status", "status", "status IN ('active', 'blocked', 'suspended')"),),
        references=(_TO_CUSTOMER,),
    ),
    Table(
        "transaction_history", "upi_transaction_history", "transaction_id",
        (
            _text("transaction_id", 50), _text("upi_id", 50), _text("customer_id", 50),
            _moment("timestamp"), _double("amount"), _text("transaction_type", 50),
            _text("merchant_id", 50, required=False), _text("counterparty_upi", 50),
            _text("status", 20), _text("device_id", 50), _text("device_type", 50),
            _text("channel", 50), _flag("fraud_flag"), _flag("reversal_flag"),
            _text("failure_reason", 100, required=False),
        ),
        rules=(
            Rule("amount not negative", "amount", "amount >= 0"),
            Rule("known status", "status", "status IN ('success', 'failed', 'pending')"),
        ),
        references=(
            _TO_CUSTOMER,
            Reference("upi_id", "account_details", "upi_id"),
            Reference("device_id", "device_info", "device_id"),
            Reference("merchant_id", "merchant", "merchant_id"),
        ),
        order="timestamp",
        bucket_by="transaction_id",
    ),
)

TABLES: dict[str, Table] = {table.name: table for table in _ALL}
