"""Step 10: the declared schemas, checked as data instead of enforced on write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import TABLES
from ..operators.audit import Link, audit
from ..operators.integrity import repeated_keys
from ..operators.lines import as_lines
from .catalog import report


def _row_checks(name: str, present: list[str]) -> list[tuple[str, str, str]]:
    """(kind, rule, SQL of a bad row) for everything a single row can tell."""
    table, checks = TABLES[name], []
    for column in table.columns:
        if column.name not in present:
            continue
        if column.required:
            checks.append(("not null", column.name, f"{column.name} IS NULL"))
        if column.width:
            too_long = f"length(CAST({column.name} AS STRING)) > {column.width}"
            checks.append(("length", f"{column.name} <= {column.width}", too_long))
    for rule in table.rules:
        if rule.column in present:
            checks.append(("check", rule.name, f"NOT ({rule.sql})"))
    return checks


def violations(t, name: str) -> DataFrame:
    """Bad rows per declared constraint: (table_name, kind, rule, violations).

    Rules and references share a shuffle; the primary key, of which nothing is combined
    before it is shuffled, travels as a hash.
    """
    table, present = TABLES[name], t.columns(name)
    checks = _row_checks(name, present)
    links = [Link(name, r.column, r.parent, r.parent_key) for r in table.references]
    repeated = repeated_keys(t.scan(name, table.key), table.key, "n").agg(
        F.expr("coalesce(sum(n - 1), 0L)"))
    counted = audit(t, links, rules={name: [bad for _, _, bad in checks]}).withColumn(
        "repeated", repeated.scalar())
    lines = [(kind, rule, f"bad_{name}_{i}") for i, (kind, rule, _) in enumerate(checks)]
    lines.append(("primary key", table.key, "repeated"))
    lines += [("foreign key", f"{r.column} -> {r.parent}.{r.parent_key}", f"lost_{i}")
              for i, r in enumerate(table.references)]
    return as_lines(counted, [
        {"table_name": f"'{name}'", "kind": f"'{kind}'", "rule": f"'{rule}'", "violations": count}
        for kind, rule, count in lines])


# The published order of the table definitions.
ORDER = ("customer_details", "device_info", "account_details", "merchant",
         "transaction_history", "customer_feedback", "fraud_alert")


def _register(number: int, name: str) -> None:
    @report(f"q10_{number:02d}_constraints_{name}")
    def constraints(t):
        return violations(t, name)


for _number, _name in enumerate(ORDER, start=1):
    _register(_number, _name)
