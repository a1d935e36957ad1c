"""Step 1: row counts, references, NULLs, domains, ranges, repeated keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..model import TABLES
from ..operators import integrity
from ..operators.audit import Link, audit
from ..operators.lines import as_lines
from ..operators.rollup import Where, rollup
from .catalog import report
from .common import ACCOUNTS, ALERTS, CUSTOMERS, DEVICES, FEEDBACK, MERCHANTS, TXN


@report("q1_01_row_counts")
def row_counts(t):
    counts = [
        t.scan(name, TABLES[name].key)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("table_name"), "row_count")
        for name in TABLES
    ]
    return reduce(lambda a, b: a.unionAll(b), counts)


@report("q1_02_orphan_account_customer", child=ACCOUNTS, on="customer_id",
        name="orphan_account_details")
@report("q1_03_orphan_device_customer", child=DEVICES, on="customer_id", name="orphan_device_info")
@report("q1_04_orphan_txn_customer", child=TXN, on="customer_id", name="orphan_txn_customer")
@report("q1_05_orphan_feedback_customer", child=FEEDBACK, on="customer_id",
        name="orphan_feedback_customer")
@report("q1_06_orphan_txn_merchant", child=TXN, on="merchant_id", name="orphan_txn_merchant",
        skip_null=True)
@report("q1_07_orphan_txn_upi", child=TXN, on="upi_id", name="orphan_txn_upi")
@report("q1_08_orphan_txn_device", child=TXN, on="device_id", name="orphan_txn_device")
@report("q1_09_orphan_alert_txn", child=ALERTS, on="transaction_id",
        name="orphan_fraud_alert_txn")
def orphan_rows(t, child, on, name, skip_null=False):
    link = next(r for r in TABLES[child].references if r.column == on)
    found = audit(t, [Link(child, on, link.parent, link.parent_key, skip_null)])
    return found.select(F.col("lost_0").alias(name))


@report("q1_10_null_counts_txn")
def null_counts(t):
    checked = ["transaction_id", "upi_id", "customer_id", "amount", "status", "fraud_flag",
               "device_type", "merchant_id", "failure_reason"]
    names = {c: f"null_{c}" for c in checked}
    for c in ("merchant_id", "failure_reason"):
        names[c] += "_expected"
    return t.scan(TXN, *checked).agg(*integrity.null_counts(checked, names))


@report("q1_11_null_merchant_by_type", column="merchant_id", by="transaction_type",
        name="null_merchant_count")
@report("q1_12_null_reason_by_status", column="failure_reason", by="status",
        name="null_failure_reason_count")
def nulls_by(t, column, by, name):
    empty = Where((column,), f"{column} IS NULL")
    return rollup(t, TXN, [by], "rows", empty).withColumnRenamed("rows", name)


@report("q1_13_distinct_status", table=TXN, column="status")
@report("q1_13_distinct_transaction_type", table=TXN, column="transaction_type")
@report("q1_13_distinct_channel", table=TXN, column="channel")
@report("q1_13_distinct_device_type", table=TXN, column="device_type")
@report("q1_14_distinct_gender", table=CUSTOMERS, column="gender")
@report("q1_14_distinct_region", table=CUSTOMERS, column="region")
def domain(t, table, column):
    return t.scan(table, column).distinct()


@report("q1_15_risk_range_customers", table=CUSTOMERS)
@report("q1_15_risk_range_merchants", table=MERCHANTS)
def risk_range(t, table):
    return integrity.range_check(t.scan(table, "risk_score"), "risk_score", 0, 1)


@report("q1_16_negative_amounts")
def negative_amounts(t):
    rows = t.scan(TXN, "amount").where(F.col("amount") < 0)
    return rows.agg(F.count(F.lit(1)).alias("negative_amount_count"))


def _repeated(table):
    @report(f"q1_17_repeated_{TABLES[table].key}")
    def repeated(t):
        key = TABLES[table].key
        return integrity.repeated_keys(t.scan(table, key), key)

    return repeated


for _table in TABLES:
    _repeated(_table)


@report("q9_07_data_quality")
def data_quality(t):
    """Row counts, NULLs and NOT IN orphans of three tables, one row each.

    NOT IN, as in SQL: one NULL among the parent's keys makes the answer 0, and no parent
    at all makes it every row.
    """
    links = [Link(TXN, "customer_id", CUSTOMERS, "customer_id"),
             Link(ALERTS, "transaction_id", TXN, "transaction_id")]
    found = audit(
        t, links, keys={CUSTOMERS: "customer_id", TXN: "transaction_id"},
        rules={CUSTOMERS: ["risk_score IS NULL"], TXN: ["amount IS NULL"], ALERTS: []},
        reads={CUSTOMERS: ["risk_score"], TXN: ["amount"]})

    def not_in(i, child, parent):
        return (f"CASE WHEN rows_{parent} = 0 THEN rows_{child} WHEN nulls_{parent} > 0 THEN 0L"
                f" ELSE lost_{i} END")

    def line(table, null_risk="0L", null_amount="0L", orphan="0L"):
        return {"table_name": f"'{table}'", "total_rows": f"rows_{table}",
                "null_risk_score": null_risk, "null_amount": null_amount, "orphan_fk": orphan}

    nulls = f"CASE WHEN rows_{TXN} > 0 THEN bad_{TXN}_0 END"
    return as_lines(found, [
        line(CUSTOMERS, null_risk=f"bad_{CUSTOMERS}_0"),
        line(TXN, null_amount=nulls, orphan=not_in(0, TXN, CUSTOMERS)),
        line(ALERTS, orphan=not_in(1, ALERTS, TXN)),
    ])
