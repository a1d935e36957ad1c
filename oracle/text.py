"""Small SQL text builders and the seven tables as common table expressions."""

from __future__ import annotations

import re

TXN_CLOCK = "TIMESTAMP '2001-11-05 00:00:00'"
FEEDBACK_CLOCK = "TIMESTAMP '2024-02-15 00:00:00'"

ROWS = "count(*)"

_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_CTES = {
    "customer_details": """
        SELECT c_custkey AS customer_id, c_name AS full_name,
               '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS mobile_number,
               CAST(18 + c_custkey % 60 AS INTEGER) AS age, c_mktsegment AS gender,
               r_name AS region,
               DATE '1995-01-01' + CAST((c_custkey * 17) % 2400 AS INTEGER) AS date_joined,
               c_mktsegment = 'MACHINERY' AS is_business_user,
               (c_acctbal + CAST(1000 AS DOUBLE)) / CAST(11000 AS DOUBLE) AS risk_score
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN region ON r_regionkey = n_regionkey""",
    "merchant": """
        SELECT s_suppkey AS merchant_id, s_name AS merchant_name, n_name AS merchant_type,
               r_name AS region,
               DATE '1995-01-01' + CAST((s_suppkey * 29) % 2400 AS INTEGER) AS onboard_date,
               (s_acctbal + CAST(1000 AS DOUBLE)) / CAST(11000 AS DOUBLE) AS risk_score
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
        LEFT JOIN region ON r_regionkey = n_regionkey""",
    "device_info": """
        SELECT p_partkey AS device_id,
               p_partkey % (SELECT count(*) FROM customer) AS customer_id,
               p_type AS device_type, p_brand AS app_version, p_size > 45 AS is_rooted,
               CAST(DATE '1995-06-01' + CAST((p_partkey * 7) % 2350 AS INTEGER) AS TIMESTAMP)
                   AS last_active
        FROM part""",
    "account_details": """
        SELECT o_orderkey AS upi_id, o_custkey AS customer_id, o_orderpriority AS bank_name,
               CASE o_orderkey % 3 WHEN 0 THEN 'savings' WHEN 1 THEN 'current' ELSE 'wallet' END
                   AS account_type,
               CAST(o_orderdate AS DATE) AS date_added,
               CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'blocked'
                   ELSE 'suspended' END AS status
        FROM orders""",
    "transaction_history": f"""
        SELECT {_ID} AS transaction_id, l_orderkey AS upi_id, o_custkey AS customer_id,
               l_shipdate + to_seconds((l_partkey * 37 + l_linenumber * 3607 + l_suppkey * 101)
                   % 86400) AS "timestamp",
               l_extendedprice AS amount,
               CASE l_returnflag WHEN 'R' THEN 'merchant_payment' WHEN 'N' THEN 'bill_pay'
                   ELSE CASE l_linestatus WHEN 'F' THEN 'send' ELSE 'receive' END END
                   AS transaction_type,
               CASE WHEN l_returnflag <> 'A' THEN l_suppkey END AS merchant_id,
               'upi' || l_suppkey AS counterparty_upi,
               CASE WHEN l_tax < 0.005 THEN 'failed' WHEN l_tax > 0.075 THEN 'pending'
                   ELSE 'success' END AS status,
               l_partkey AS device_id, p_type AS device_type, 'ch' || l_linenumber AS channel,
               l_discount > 0.095 AS fraud_flag, l_quantity >= 49 AS reversal_flag,
               CASE WHEN l_tax < 0.005 THEN 'reason' || (CAST(l_quantity AS INTEGER) % 4) END
                   AS failure_reason
        FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
        LEFT JOIN part ON p_partkey = l_partkey""",
    "fraud_alert": """
        SELECT transaction_id || '#' || k AS alert_id, transaction_id,
               'type' || right(channel, 1) AS alert_type,
               "timestamp" + to_minutes(17 * k) AS alert_date,
               device_id % 4 <> 0 AS resolved,
               CASE WHEN device_id % 4 <> 0 THEN
                   "timestamp" + to_minutes(17 * k + (device_id * 53) % 4000) END
                   AS resolution_date,
               CASE WHEN device_id % 4 <> 0 THEN 'closed in round ' || k END AS remarks
        FROM transaction_history, (SELECT 1 AS k UNION ALL SELECT 2) AS rounds
        WHERE fraud_flag AND channel IN ('ch1', 'ch3', 'ch5') AND (k = 1 OR channel = 'ch1')""",
    "customer_feedback": """
        SELECT event_id AS feedback_id, user_id AS customer_id,
               CAST(ts AS DATE) AS date_submitted, props AS feedback_text,
               CAST(1 + event_id % 5 AS INTEGER) AS satisfaction_score,
               event_type AS issue_type, event_id % 3 <> 0 AS resolved
        FROM events""",
}


def statement(body: str) -> str:
    """Prefix the tables that the body mentions."""
    wanted = {name for name in _CTES if re.search(rf"\b{name}\b", body)}
    if "fraud_alert" in wanted:
        wanted.add("transaction_history")
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in _CTES.items() if name in wanted)
    return f"WITH {ctes}\n{body}"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def tally(condition: str) -> str:
    return big(f"sum(CASE WHEN {condition} THEN 1 ELSE 0 END)")


def pct(part: str, whole: str = ROWS) -> str:
    return f"((20000 * {part} + {whole}) // (2 * nullif({whole}, 0))) / 100.0"


def rate(condition: str, whole: str = ROWS) -> str:
    return pct(tally(condition), whole)


def money_sum(column: str = "amount") -> str:
    """Hundredths exactly; what is smaller is summed apart and added."""
    return _split(column, 2)


def _split(column: str, digits: int) -> str:
    fixed = f"CAST({column} AS DECIMAL(18, {digits}))"
    return f"(CAST(sum({fixed}) AS DOUBLE) + sum({column} - CAST({fixed} AS DOUBLE)))"


def money_avg(column: str = "amount") -> str:
    return f"{money_sum(column)} / nullif(count({column}), 0)"


def risk_avg(column: str = "risk_score") -> str:
    return f"{_split(column, 10)} / nullif(count({column}), 0)"


def score_avg(column: str = "satisfaction_score") -> str:
    return f"CAST(sum({column}) AS DOUBLE) / nullif(count({column}), 0)"


def whole_avg(expr: str) -> str:
    return big(f"sum({expr}) // nullif(count({expr}), 0)")


def money_avg_2dp(column: str = "amount", count: str = "") -> str:
    """Halves away from zero, in whole hundredths."""
    count = count or f"count({column})"
    cents = f"CAST(sum(CAST({column} AS DECIMAL(18, 2))) * 100 AS HUGEINT)"
    size = f"CAST((2 * abs({cents}) + {count}) // (2 * nullif({count}, 0)) AS DOUBLE) / 100"
    rest = f"sum({column} - CAST(CAST({column} AS DECIMAL(18, 2)) AS DOUBLE))"
    return (f"CASE WHEN {rest} = 0 THEN sign({cents}) * {size}"
            f" ELSE round({money_sum(column)} / nullif({count}, 0), 2) END")


def score_avg_2dp(column: str = "satisfaction_score") -> str:
    return (f"((200 * {big(f'sum({column})')} + count({column}))"
            f" // (2 * nullif(count({column}), 0))) / 100.0")


def r2(expr: str) -> str:
    return f"round({expr}, 2)"


def month(column: str) -> str:
    return f"strftime({column}, '%Y-%m')"


def share() -> str:
    return pct("count(*)", "CAST(sum(count(*)) OVER () AS BIGINT)")


def query(source: str, keys: dict | list = (), where: str = "", having: str = "",
          order: str = "", limit: int = 0, **measures: str) -> str:
    """SELECT keys and measures FROM source, grouped by the keys."""
    if not isinstance(keys, dict):
        keys = {k.split(".")[-1]: k for k in keys}
    columns = [f"{sql} AS {name}" for name, sql in {**keys, **measures}.items()]
    text = f"SELECT {', '.join(columns)} FROM {source}"
    if where:
        text += f" WHERE {where}"
    if keys and measures:
        text += f" GROUP BY {', '.join(keys.values())}"
    if having:
        text += f" HAVING {having}"
    if order:
        text += f" ORDER BY {order}"
    if limit:
        text += f" LIMIT {limit}"
    return text


def case(*steps: tuple[str, str], rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in steps) + f" ELSE '{rest}' END"
