"""One statement per report name."""

from __future__ import annotations

from .text import (
    FEEDBACK_CLOCK, ROWS, TXN_CLOCK, big, case, money_avg, money_avg_2dp, money_sum, month, pct, query, r2, rate,
    risk_avg, score_avg, score_avg_2dp, share, statement, tally, whole_avg,
)

T, C, M, D, A, F, FA = (
    "transaction_history", "customer_details", "merchant", "device_info", "account_details",
    "customer_feedback", "fraud_alert",
)
KEYS = {C: "customer_id", F: "feedback_id", D: "device_id", FA: "alert_id", M: "merchant_id",
        A: "upi_id", T: "transaction_id"}

FAILED, PENDING, SUCCESS = (f"status = '{s}'" for s in ("failed", "pending", "success"))
FRAUD, REVERSED = "fraud_flag", "reversal_flag"
T_C = f"{T} t JOIN {C} c USING (customer_id)"
T_M = f"{T} t JOIN {M} m USING (merchant_id)"
T_D = f"{T} t JOIN {D} d ON d.device_id = t.device_id"
T_A = f"{T} t JOIN {A} a ON a.upi_id = t.upi_id"
C_T = f"{C} c LEFT JOIN {T} t ON t.customer_id = c.customer_id"
IDS = "count(transaction_id)"
HOURS = "datediff('hour', alert_date, resolution_date)"
RISK = (("risk_score >= 0.7", "High Risk (0.7-1.0)"), ("risk_score >= 0.4",
        "Medium Risk (0.4-0.7)"))


def _union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def _validation() -> dict[str, str]:
    out = {"q1_01_row_counts": _union(*[
        f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}" for name in KEYS])}

    def orphan(child, key, parent, name, more=""):
        return (f"SELECT count(*) AS {name} FROM {child} x WHERE NOT EXISTS "
                f"(SELECT 1 FROM {parent} p WHERE p.{key} = x.{key}){more}")

    out["q1_02_orphan_account_customer"] = orphan(A, "customer_id", C, "orphan_account_details")
    out["q1_03_orphan_device_customer"] = orphan(D, "customer_id", C, "orphan_device_info")
    out["q1_04_orphan_txn_customer"] = orphan(T, "customer_id", C, "orphan_txn_customer")
    out["q1_05_orphan_feedback_customer"] = orphan(
        F, "customer_id", C, "orphan_feedback_customer")
    out["q1_06_orphan_txn_merchant"] = orphan(
        T, "merchant_id", M, "orphan_txn_merchant", " AND x.merchant_id IS NOT NULL")
    out["q1_07_orphan_txn_upi"] = orphan(T, "upi_id", A, "orphan_txn_upi")
    out["q1_08_orphan_txn_device"] = orphan(T, "device_id", D, "orphan_txn_device")
    out["q1_09_orphan_alert_txn"] = orphan(FA, "transaction_id", T, "orphan_fraud_alert_txn")
    out["q6_03_customers_without_txns"] = orphan(
        C, "customer_id", T, "customers_with_no_transactions")
    out["q7_03_merchants_without_txns"] = orphan(M, "merchant_id", T, "inactive_merchants")

    names = {c: f"null_{c}" for c in ("transaction_id", "upi_id", "customer_id", "amount",
                                      "status", "fraud_flag", "device_type")}
    names |= {c: f"null_{c}_expected" for c in ("merchant_id", "failure_reason")}
    out["q1_10_null_counts_txn"] = query(
        T, **{name: tally(f"{c} IS NULL") for c, name in names.items()})
    out["q1_11_null_merchant_by_type"] = query(
        T, ["transaction_type"], "merchant_id IS NULL", null_merchant_count=ROWS)
    out["q1_12_null_reason_by_status"] = query(
        T, ["status"], "failure_reason IS NULL", null_failure_reason_count=ROWS)
    for table, column in ((T, "status"), (T, "transaction_type"), (T, "channel"),
                          (T, "device_type"), (C, "gender"), (C, "region")):
        out[f"q1_{13 if table == T else 14}_distinct_{column}"] = (
            f"SELECT DISTINCT {column} FROM {table}")
    for table, plural in ((C, "customers"), (M, "merchants")):
        out[f"q1_15_risk_range_{plural}"] = query(
            table, min_risk="min(risk_score)", max_risk="max(risk_score)",
            out_of_range=tally("risk_score < 0 OR risk_score > 1"))
    out["q1_16_negative_amounts"] = query(T, where="amount < 0", negative_amount_count=ROWS)
    for table, key in KEYS.items():
        out[f"q1_17_repeated_{key}"] = query(table, [key], having="count(*) > 1", row_count=ROWS)

    def quality(table, risk="0", amount="0", orphans="0"):
        return (f"SELECT '{table}' AS table_name, (SELECT count(*) FROM {table}) AS total_rows,"
                f" {big(risk)} AS null_risk_score, {big(amount)} AS null_amount,"
                f" {big(orphans)} AS orphan_fk")

    out["q9_07_data_quality"] = _union(
        quality(C, risk=f"(SELECT count(*) FROM {C} WHERE risk_score IS NULL)"),
        quality(T, amount=f"(SELECT {tally('amount IS NULL')} FROM {T})",
                orphans=f"(SELECT count(*) FROM {T} WHERE customer_id NOT IN"
                        f" (SELECT customer_id FROM {C}))"),
        quality(FA, orphans=f"(SELECT count(*) FROM {FA} WHERE transaction_id NOT IN"
                            f" (SELECT transaction_id FROM {T}))"),
    )
    return out


def _kpi() -> dict[str, str]:
    seen = f"timestamp >= {TXN_CLOCK} - INTERVAL 90 DAY"
    active = f"count(DISTINCT CASE WHEN {seen} THEN customer_id END)"
    return {
        "q2_01_volume": query(
            T, total_transactions=ROWS, total_value_inr=money_sum(),
            avg_transaction_amount=money_avg(), min_amount="min(amount)",
            max_amount="max(amount)"),
        "q2_02_status_rates": query(
            T, total_transactions=ROWS, failed_count=tally(FAILED), success_count=tally(SUCCESS),
            pending_count=tally(PENDING), failure_rate_pct=rate(FAILED),
            success_rate_pct=rate(SUCCESS)),
        "q2_03_fraud_rate": query(
            T, total_transactions=ROWS, fraud_flagged_count=tally(FRAUD),
            fraud_rate_pct=rate(FRAUD)),
        "q2_04_reversal_rate": query(
            T, reversed_count=tally(REVERSED), reversal_rate_pct=rate(REVERSED)),
        "q2_05_alert_resolution": query(
            FA, total_alerts=ROWS, resolved_alerts=tally("resolved"),
            open_alerts=tally("NOT resolved"), resolution_rate_pct=rate("resolved")),
        "q2_06_resolution_hours": query(
            FA, where="resolved AND resolution_date IS NOT NULL",
            avg_resolution_hours=whole_avg(HOURS), min_resolution_hours=f"min({HOURS})",
            max_resolution_hours=f"max({HOURS})"),
        "q2_07_retention": query(
            T, total_customers="count(DISTINCT customer_id)", active_last_90_days=active,
            retention_rate_pct=pct(active, "count(DISTINCT customer_id)")),
        "q2_08_satisfaction": query(
            F, avg_satisfaction_score=score_avg_2dp(), total_feedbacks=ROWS,
            resolved_feedbacks=tally("resolved"),
            feedback_resolution_rate_pct=rate("resolved")),
    }


def _explore() -> dict[str, str]:
    ages = case(("age < 25", "Under 25"), ("age < 35", "25-34"), ("age < 45", "35-44"),
                ("age < 55", "45-54"), rest="55+")
    merchant = ["merchant_id", "merchant_name", "merchant_type", "m.region"]
    customer = ["customer_id", "full_name", "region"]
    return {
        "p1_p90_amount": query(T, p90_amount="quantile_cont(amount, 0.9)"),
        "p2_top_merchant_ids": query(
            T, ["merchant_id"], txn_count=ROWS, limit=10,
            order="txn_count DESC, merchant_id NULLS FIRST"),
        "q3_01_by_transaction_type": query(
            T, ["transaction_type"], txn_count=ROWS, total_amount=money_sum(),
            avg_amount=money_avg(), min_amount="min(amount)", max_amount="max(amount)"),
        "q3_02_by_type_and_status": query(
            T, ["transaction_type", "status"], txn_count=ROWS, total_amount=money_sum()),
        "q3_03_monthly_trend": query(
            T, {"year_month": month("timestamp")}, txn_count=ROWS, total_amount=money_sum(),
            fraud_count=tally(FRAUD), failed_count=tally(FAILED)),
        "q3_04_daily_volume": query(
            T, {"txn_date": "CAST(timestamp AS DATE)"},
            f"timestamp >= {TXN_CLOCK} - INTERVAL 30 DAY", txn_count=ROWS,
            total_amount=money_sum()),
        "q3_05_by_channel": query(
            T, ["channel"], txn_count=ROWS, total_amount=money_sum(), pct_share=share(),
            failed_count=tally(FAILED), failure_rate_pct=rate(FAILED)),
        "q3_06_by_device_type": query(
            T, ["device_type"], txn_count=ROWS, total_amount=money_sum(),
            fraud_count=tally(FRAUD), fraud_rate_pct=rate(FRAUD), failure_rate_pct=rate(FAILED)),
        "q3_07_by_region": query(
            T_C, ["region"], txn_count=IDS, total_amount=money_sum(), avg_amount=money_avg(),
            fraud_count=tally(FRAUD), fraud_rate_pct=rate(FRAUD), failure_rate_pct=rate(FAILED)),
        "q3_08_by_merchant_type": query(
            T_M, ["merchant_type"], active_merchants="count(DISTINCT t.merchant_id)",
            txn_count=IDS, total_amount=money_sum(), avg_amount=money_avg(),
            fraud_count=tally(FRAUD), fraud_rate_pct=rate(FRAUD), failure_rate_pct=rate(FAILED)),
        "q3_09_top_merchants": query(
            T_M, merchant, txn_count=IDS, total_amount=money_sum(), limit=10,
            order="txn_count DESC, merchant_id"),
        "q3_10_top_customers": query(
            T_C, customer, txn_count=IDS, total_amount=money_sum(), avg_amount=money_avg(),
            limit=10, order="total_amount DESC, customer_id"),
        "q3_11_customers_by_gender": query(
            C, ["gender"], customer_count=ROWS, avg_age=whole_avg("age"),
            avg_risk_score=risk_avg(), business_users=tally("is_business_user")),
        "q3_12_customers_by_age": query(
            C, {"age_group": ages}, customer_count=ROWS, avg_risk_score=risk_avg()),
        "q3_13_accounts_by_type": query(
            A, ["account_type"], account_count=ROWS, pct_share=share()),
        "q3_14_accounts_by_bank": query(A, ["bank_name"], account_count=ROWS, pct_share=share()),
        "q3_15_failure_reasons": query(
            T, ["failure_reason"], f"{FAILED} AND failure_reason IS NOT NULL",
            failure_count=ROWS, pct_share=share()),
        "q3_16_by_hour": query(
            T, {"hour_of_day": "CAST(hour(timestamp) AS INTEGER)"}, txn_count=ROWS,
            fraud_count=tally(FRAUD), failed_count=tally(FAILED)),
        "q3_17_by_weekday": query(
            T, {"day_of_week": "dayname(timestamp)",
                "day_num": "CAST(dayofweek(timestamp) + 1 AS INTEGER)"},
            txn_count=ROWS, total_amount=money_sum()),
        "q4_01_value_per_customer": query(
            T, ["customer_id"], total_transactions=IDS, total_amount=money_sum(),
            txn_value_per_customer=money_avg_2dp(count=IDS)),
        "q4_02_merchant_fraud_ratio": query(
            T_M, {**{k.split(".")[-1]: k for k in merchant}, "merchant_risk_score": "m.risk_score"},
            total_txns=IDS, fraud_txns=tally(FRAUD), merchant_fraud_ratio_pct=rate(FRAUD)),
        "q4_03_device_fraud_ratio": query(
            T, ["device_type"], total_txns=IDS, fraud_txns=tally(FRAUD),
            device_fraud_ratio_pct=rate(FRAUD)),
        "q4_04_channel_failure_rate": query(
            T, ["channel"], total_txns=ROWS, failed_txns=tally(FAILED),
            failure_rate_pct=rate(FAILED)),
        "q4_05_customer_risk_summary": query(
            T_C, {**{k: k for k in customer}, "customer_risk_score": "risk_score",
                  "is_business_user": "is_business_user"},
            total_txns=IDS, total_amount=money_sum(), fraud_txns=tally(FRAUD),
            failed_txns=tally(FAILED), fraud_rate_pct=rate(FRAUD), failure_rate_pct=rate(FAILED)),
    }


def _fraud() -> dict[str, str]:
    counts = dict(total_txns=IDS, fraud_txns=tally(FRAUD), fraud_rate_pct=rate(FRAUD))
    rows = {**counts, "total_txns": ROWS}
    segment = (f"CASE WHEN amount >= (SELECT quantile_cont(amount, 0.9) FROM {T})"
               " THEN 'High Value' ELSE 'Normal' END")
    part = case(("hour(timestamp) < 6", "Night (00-05)"), ("hour(timestamp) < 12",
                "Morning (06-11)"), ("hour(timestamp) < 18", "Afternoon (12-17)"),
                rest="Evening (18-23)")
    with_alerts = f"{T} t LEFT JOIN {FA} fa ON fa.transaction_id = t.transaction_id"
    flagged = "count(DISTINCT CASE WHEN fraud_flag THEN t.transaction_id END)"
    return {
        "q5_01_alert_types": query(
            FA, ["alert_type"], alert_count=ROWS, resolved_count=tally("resolved"),
            open_count=tally("NOT resolved"), resolution_rate_pct=rate("resolved"),
            avg_resolution_hours=whole_avg(HOURS)),
        "q5_02_fraud_by_region": query(T_C, ["region"], **counts),
        "q5_03_fraud_by_device_type": query(T, ["device_type"], **rows),
        "q5_04_fraud_by_channel": query(T, ["channel"], **rows),
        "q5_05_fraud_by_rooted": query(
            T_D, ["is_rooted"], **counts, avg_txn_amount=money_avg()),
        "q5_06_high_value_fraud": query(
            f"(SELECT {segment} AS txn_segment, fraud_flag FROM {T})", ["txn_segment"],
            txn_count=ROWS, fraud_count=tally(FRAUD), fraud_rate_pct=rate(FRAUD)),
        "q5_07_fraud_by_merchant_risk": query(
            T_M, {"merchant_risk_band": case(*RISK, rest="Low Risk (0-0.4)")}, **counts),
        "q5_08_fraud_by_customer_risk": query(
            T_C, {"customer_risk_band": case(*RISK, rest="Low Risk (0-0.4)")}, **counts,
            avg_txn_amount=money_avg()),
        "q5_09_fraud_by_day_part": query(
            with_alerts, {"time_band": part}, **rows, fraud_alerts="count(DISTINCT alert_id)"),
        "q5_10_riskiest_merchants": query(
            T_M, ["merchant_id", "merchant_name", "merchant_type", "m.region", "risk_score"],
            having=f"{IDS} >= 10", order="fraud_rate_pct DESC, merchant_id", limit=10, **counts),
        "q5_11_flagged_and_alerted": query(
            with_alerts, flagged_in_both="count(DISTINCT t.transaction_id)",
            total_alerts="count(DISTINCT alert_id)", flagged_transactions=flagged),
        "q5_12_fraud_by_month": query(T, {"year_month": month("timestamp")}, **rows),
    }


def _people() -> dict[str, str]:
    segment = case(("n = 0", "Inactive"), ("n <= 5", "Low Activity (1-5)"),
                   ("n <= 20", "Medium Activity (6-20)"), rest="High Activity (20+)")
    per_customer = query(T, ["customer_id"], n=IDS, s=money_sum())
    joined = f"CASE WHEN date_joined >= {TXN_CLOCK} - INTERVAL 6 MONTH"
    f_c = f"{F} f JOIN {C} c ON c.customer_id = f.customer_id"
    per_name = query(T_M, ["m.region", "merchant_name", "merchant_type"], txn_count=IDS,
                     total_amount=money_sum())
    return {
        "q6_01_business_vs_regular": query(
            C_T, ["is_business_user"], customer_count="count(DISTINCT c.customer_id)",
            total_txns=IDS, total_amount=money_sum(), avg_txn_amount=money_avg(),
            fraud_txns=tally(FRAUD), fraud_rate_pct=rate(FRAUD)),
        "q6_02_activity_segments": query(
            f"({per_customer})", {"activity_segment": segment}, customer_count=ROWS,
            avg_txns=whole_avg("n"),
            avg_total_amount=money_avg("s")),
        "q6_04_new_vs_existing": query(
            C_T, {"customer_type": f"{joined} THEN 'New Customer' ELSE 'Existing Customer' END"},
            customer_count="count(DISTINCT c.customer_id)", total_txns=IDS,
            avg_txn_amount=money_avg(), fraud_rate_pct=rate(FRAUD)),
        "q6_05_feedback_by_issue": query(
            F, ["issue_type"], feedback_count=ROWS, avg_satisfaction=score_avg(),
            resolved_count=tally("resolved"), resolution_rate_pct=rate("resolved")),
        "q6_06_unhappy_customers": query(
            f_c, ["f.customer_id", "full_name", "region", "issue_type", "satisfaction_score",
                  "resolved", "date_submitted"],
            "satisfaction_score <= 2 AND NOT resolved"),
        "q7_01_failures_by_region": query(
            T_M, ["m.region"], total_txns=IDS, failed_txns=tally(FAILED),
            failure_rate_pct=rate(FAILED), avg_txn_amount=money_avg()),
        "q7_02_onboarding": query(
            M, {"onboard_month": month("onboard_date")}, new_merchants=ROWS),
        "q7_04_top_merchants_by_region": (
            f"SELECT * FROM ({per_name}) QUALIFY row_number() OVER (PARTITION BY region"
            " ORDER BY txn_count DESC, merchant_name, merchant_type) <= 3"),
        "q8_01_rooted_share": query(D, ["is_rooted"], device_count=ROWS, pct_share=share()),
        "q8_02_rooted_by_region": query(
            f"{D} d JOIN {C} c ON c.customer_id = d.customer_id", ["region"],
            total_devices="count(device_id)", rooted_devices=tally("is_rooted"),
            rooted_pct=rate("is_rooted")),
        "q8_03_app_versions": query(D, ["app_version"], device_count=ROWS, pct_share=share()),
        "q8_04_stale_devices": query(
            D, where=f"last_active < {TXN_CLOCK} - INTERVAL 90 DAY", inactive_90_days_count=ROWS),
        "q8_05_rooted_by_device_type": query(
            D, ["device_type"], total_devices=ROWS, rooted_count=tally("is_rooted"),
            rooted_pct=rate("is_rooted")),
    }


def _executive() -> dict[str, str]:
    def one(source, expr):
        return f"(SELECT {expr} FROM {source})"

    summary = {
        "total_transactions": one(T, ROWS), "total_value_inr": one(T, r2(money_sum())),
        "avg_txn_amount": one(T, money_avg_2dp()), "failure_rate_pct": one(T, rate(FAILED)),
        "fraud_rate_pct": one(T, rate(FRAUD)), "reversal_rate_pct": one(T, rate(REVERSED)),
        "total_customers": one(C, ROWS), "total_merchants": one(M, ROWS),
        "avg_satisfaction_score": one(F, score_avg_2dp()),
        "fraud_alert_resolution_rate_pct": one(FA, rate("resolved")),
    }
    person = ["c.customer_id", "full_name", "region", "risk_score", "is_business_user"]
    chain = (f"{C_T} LEFT JOIN {FA} fa ON fa.transaction_id = t.transaction_id"
             f" LEFT JOIN {F} f ON f.customer_id = c.customer_id")

    def card(source, key, ident, count, risk):
        return query(
            source, [key], total_txns=IDS, total_amount=r2(money_sum()),
            avg_txn_amount=money_avg_2dp(), fraud_rate_pct=rate(FRAUD),
            failure_rate_pct=rate(FAILED),
            **{count: f"count(DISTINCT {ident})", risk: "round(avg(risk_score), 4)"})

    monthly = query(T, {"yr_month": month("timestamp")}, txn_count=ROWS, total_amount=money_sum())
    change = pct("abs(txn_count - prev_month_txns)", "prev_month_txns")
    return {
        "q9_01_executive_summary":
            "SELECT " + ", ".join(f"{v} AS {k}" for k, v in summary.items()),
        "q9_02_customers_needing_action": query(
            chain, person, having=f"{tally(FRAUD)} > 0", limit=20,
            order="fraud_alerts DESC, risk_score DESC, c.customer_id",
            total_txns="count(t.transaction_id)", fraud_txns=tally(FRAUD),
            failed_txns=tally(FAILED), fraud_alerts="count(alert_id)",
            avg_satisfaction=score_avg()),
        "q9_03_region_scorecard": card(
            C_T, "region", "c.customer_id", "total_customers", "avg_customer_risk_score"),
        "q9_04_merchant_type_scorecard": card(
            f"{M} m LEFT JOIN {T} t ON t.merchant_id = m.merchant_id", "merchant_type",
            "m.merchant_id", "merchant_count", "avg_merchant_risk_score"),
        "q9_05_channel_scorecard": query(
            T, ["channel"], total_txns=ROWS, total_amount=r2(money_sum()),
            fraud_rate_pct=rate(FRAUD), failure_rate_pct=rate(FAILED),
            reversal_rate_pct=rate(REVERSED)),
        "q9_06_monthly_growth": (
            f"SELECT *, sign(txn_count - prev_month_txns) * {change} AS mom_growth_pct"
            f" FROM (SELECT *, lag(txn_count) OVER (ORDER BY yr_month) AS prev_month_txns"
            f" FROM ({monthly}))"),
    }


# Declared lengths, required columns, rules and references.
DECLARED = {
    C: dict(required="customer_id full_name mobile_number age gender region date_joined"
                     " is_business_user risk_score",
            widths=dict(customer_id=50, full_name=200, mobile_number=20, gender=20, region=50),
            rules={"age between 1 and 119": "age > 0 AND age < 120",
                   "risk_score within 0 and 1": "risk_score >= 0 AND risk_score <= 1"},
            refs=()),
    D: dict(required="device_id customer_id device_type app_version is_rooted last_active",
            widths=dict(device_id=50, customer_id=50, device_type=50, app_version=20),
            rules={}, refs=(("customer_id", C),)),
    A: dict(required="upi_id customer_id bank_name account_type date_added status",
            widths=dict(upi_id=50, customer_id=50, bank_name=50, account_type=50, status=20),
            rules={"known status": "status IN ('active', 'blocked', 'suspended')"},
            refs=(("customer_id", C),)),
    M: dict(required="merchant_id merchant_name merchant_type region onboard_date risk_score",
            widths=dict(merchant_id=50, merchant_name=200, merchant_type=50, region=50),
            rules={"risk_score within 0 and 1": "risk_score >= 0 AND risk_score <= 1"}, refs=()),
    T: dict(required="transaction_id upi_id customer_id timestamp amount transaction_type"
                     " counterparty_upi status device_id device_type channel fraud_flag"
                     " reversal_flag",
            widths=dict(transaction_id=50, upi_id=50, customer_id=50, transaction_type=50,
                        merchant_id=50, counterparty_upi=50, status=20, device_id=50,
                        device_type=50, channel=50, failure_reason=100),
            rules={"amount not negative": "amount >= 0",
                   "known status": "status IN ('success', 'failed', 'pending')"},
            refs=(("customer_id", C), ("upi_id", A), ("device_id", D), ("merchant_id", M))),
    F: dict(required="feedback_id customer_id date_submitted satisfaction_score issue_type"
                     " resolved",
            widths=dict(feedback_id=50, customer_id=50, feedback_text=500, issue_type=50),
            rules={"satisfaction_score between 1 and 5": "satisfaction_score BETWEEN 1 AND 5"},
            refs=(("customer_id", C),)),
    FA: dict(required="alert_id transaction_id alert_type alert_date resolved",
             widths=dict(alert_id=50, transaction_id=50, alert_type=50, remarks=500),
             rules={}, refs=(("transaction_id", T),)),
}


def _constraints() -> dict[str, str]:
    out = {}
    for number, (table, declared) in enumerate(DECLARED.items(), start=1):
        def line(kind, rule, count, table=table):
            return (f"SELECT '{table}' AS table_name, '{kind}' AS kind, '{rule}' AS rule,"
                    f" {count} AS violations")

        def where(condition, table=table):
            return f"(SELECT count(*) FROM {table} x WHERE {condition})"

        lines = [line("not null", c, where(f"{c} IS NULL"))
                 for c in declared["required"].split()]
        lines += [line("length", f"{c} <= {w}", where(f"length(CAST({c} AS VARCHAR)) > {w}"))
                  for c, w in declared["widths"].items()]
        lines += [line("check", rule, where(f"NOT ({sql})"))
                  for rule, sql in declared["rules"].items()]
        key = KEYS[table]
        lines.append(line("primary key", key, f"(SELECT {big('coalesce(sum(n - 1), 0)')} FROM"
                          f" (SELECT count(*) AS n FROM {table} GROUP BY {key}))"))
        lines += [line("foreign key", f"{c} -> {parent}.{KEYS[parent]}", where(
            f"{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p"
            f" WHERE p.{KEYS[parent]} = x.{c})")) for c, parent in declared["refs"]]
        out[f"q10_{number:02d}_constraints_{table}"] = _union(*lines)
    return out


def _money() -> dict[str, str]:
    reversal = dict(reversed_txns=tally(REVERSED), reversal_rate_pct=rate(REVERSED))
    age = f"datediff('day', timestamp, {TXN_CLOCK})"
    bucket = case((f"{age} <= 1", "0-1 days"), (f"{age} <= 7", "2-7 days"),
                  (f"{age} <= 30", "8-30 days"), rest="Over 30 days (stale)")
    spread = dict(min_amount=r2("min(amount)"), max_amount=r2("max(amount)"),
                  std_dev_amount=r2("stddev_samp(amount)"))
    flag = "CAST(fraud_flag AS DOUBLE)"
    percent = {"p25": .25, "p50_median": .5, "p75": .75, "p90": .9, "p95": .95, "p99": .99}
    return {
        "q11_01_accounts_by_status": query(A, ["status"], account_count=ROWS, pct_share=share()),
        "q11_02_activity_on_closed_accounts": query(
            T_A, ["a.upi_id", "a.customer_id", "bank_name", "account_type", "a.status"],
            "a.status IN ('blocked', 'suspended')", txn_count_on_inactive_account=IDS,
            last_txn_date="max(timestamp)"),
        "q11_03_customers_with_several_accounts": query(
            A, ["customer_id"], having="count(upi_id) > 1", upi_count="count(upi_id)",
            banks="string_agg(bank_name, ', ' ORDER BY bank_name)"),
        "q11_04_txns_by_bank": query(
            T_A, ["bank_name"], total_txns=IDS, total_amount=r2(money_sum()),
            fraud_txns=tally(FRAUD), fraud_rate_pct=rate(FRAUD),
            failure_rate_pct=rate("t.status = 'failed'")),
        "q11_05_txns_by_account_type": query(
            T_A, ["account_type"], total_txns=IDS, avg_txn_amount=money_avg_2dp(),
            fraud_txns=tally(FRAUD), fraud_rate_pct=rate(FRAUD)),
        "q12_01_reversals_by_type": query(T, ["transaction_type"], total_txns=ROWS, **reversal),
        "q12_02_reversals_by_channel": query(T, ["channel"], total_txns=ROWS, **reversal),
        "q12_03_reversals_by_merchant_type": query(
            T_M, ["merchant_type"], total_txns=IDS, **reversal),
        "q12_04_reversed_and_fraud": query(
            T, where=f"{REVERSED} AND {FRAUD}", reversed_and_fraud_count=ROWS,
            total_amount_at_risk=r2(money_sum())),
        "q12_05_reversals_by_month": query(
            T, {"year_month": month("timestamp")}, total_txns=ROWS, **reversal),
        "q13_01_pending_by_age": query(
            T, {"aging_bucket": bucket}, PENDING, pending_count=ROWS,
            total_amount_at_risk=r2(money_sum())),
        "q13_02_largest_pending": query(
            T_C, ["customer_id", "full_name", "region"], PENDING, pending_txns=IDS,
            total_pending_amount=r2(money_sum()), limit=10,
            order="total_pending_amount DESC, customer_id"),
        "q14_01_amount_by_device_type": query(
            T, ["device_type"], txn_count=ROWS, mean_amount=money_avg_2dp(), **spread),
        "q14_02_amount_by_region": query(
            T_C, ["region"], txn_count=IDS, mean_amount=money_avg_2dp(), **spread),
        "q14_03_fraud_by_merchant_type": query(
            T_M, ["merchant_type"], txn_count=IDS, fraud_count=tally(FRAUD),
            fraud_rate_pct=rate(FRAUD), fraud_mean=f"((20000 * {tally(FRAUD)} + count(fraud_flag)) // (2 * count(fraud_flag))) / 10000.0",
            fraud_std_dev=f"round(stddev_samp({flag}), 4)"),
        "q14_04_channel_by_fraud": query(
            T, ["channel"], fraud_yes=tally(FRAUD), fraud_no=tally(f"NOT {FRAUD}"), total=ROWS),
        "q14_05_device_type_by_status": query(
            T, ["device_type"], success_count=tally(SUCCESS), failed_count=tally(FAILED),
            pending_count=tally(PENDING), total=ROWS),
        "q14_06_customer_fraud_rate": query(
            C_T, ["c.customer_id", "risk_score"], txn_count=IDS, fraud_txns=tally(FRAUD),
            individual_fraud_rate_pct=rate(FRAUD, IDS)),
        "q14_07_rooted_comparison": query(
            T_D, ["is_rooted"], txn_count=IDS, fraud_count=tally(FRAUD),
            fraud_rate_pct=rate(FRAUD), avg_amount=money_avg_2dp(),
            std_dev_amount=spread["std_dev_amount"]),
        "q14_08_amount_percentiles": query(
            T, **{name: r2(f"quantile_cont(amount, {p})") for name, p in percent.items()}),
    }


def _feedback_and_views() -> dict[str, str]:
    f_c = f"{F} f JOIN {C} c ON c.customer_id = f.customer_id"
    score = score_avg_2dp()
    chain = (f"{C} c LEFT JOIN {A} a ON a.customer_id = c.customer_id"
             f" LEFT JOIN {D} d ON d.customer_id = c.customer_id"
             f" LEFT JOIN {T} t ON t.customer_id = c.customer_id"
             f" LEFT JOIN {F} f ON f.customer_id = c.customer_id")
    person = ["c.customer_id", "full_name", "age", "gender", "region", "date_joined",
              "is_business_user", "risk_score"]
    rowwise = (f"{T} t JOIN {C} c ON c.customer_id = t.customer_id"
               f" JOIN {D} d ON d.device_id = t.device_id"
               f" LEFT JOIN {FA} fa ON fa.transaction_id = t.transaction_id"
               f" LEFT JOIN {M} m ON m.merchant_id = t.merchant_id")
    columns = {c: f"t.{c}" for c in (
        "transaction_id", "customer_id", "amount", "transaction_type", "channel", "device_type",
        "status", "fraud_flag", "reversal_flag", "timestamp")}
    columns |= {c: c for c in ("full_name", "is_rooted", "alert_id", "alert_type", "alert_date",
                               "merchant_name", "merchant_type")}
    columns |= {"region": "c.region", "customer_risk_score": "c.risk_score",
                "merchant_risk_score": "m.risk_score", "alert_resolved": "fa.resolved"}
    out = {
        "q15_01_score_by_month": query(
            F, {"year_month": month("date_submitted")}, feedback_count=ROWS,
            avg_satisfaction=score, low_score_count=tally("satisfaction_score <= 2"),
            high_score_count=tally("satisfaction_score >= 4")),
        "q15_02_score_by_region": query(
            f_c, ["region"], feedback_count="count(feedback_id)", avg_satisfaction=score,
            unresolved_issues=tally("NOT resolved")),
        "q15_03_overdue_issues": query(
            f_c, {**{c: c for c in ("feedback_id", "full_name", "issue_type",
                                    "satisfaction_score", "date_submitted")},
                  "customer_id": "f.customer_id",
                  "days_open": f"CAST(datediff('day', date_submitted, {FEEDBACK_CLOCK})"
                               " AS INTEGER)"},
            f"NOT resolved AND date_submitted < {FEEDBACK_CLOCK} - INTERVAL 30 DAY"),
        "q15_04_resolution_by_issue": query(
            F, ["issue_type"], total_issues=ROWS, resolved_count=tally("resolved"),
            resolution_rate_pct=rate("resolved"), avg_satisfaction=score),
        "q16_01_vw_executive_kpis": query(
            T_C, {"year_month": month("timestamp"), **{c: c for c in (
                "region", "channel", "device_type", "transaction_type")}},
            total_txns=IDS, total_amount=r2(money_sum()), avg_amount=money_avg_2dp(),
            fraud_count=tally(FRAUD), failed_count=tally(FAILED), reversal_count=tally(REVERSED),
            fraud_rate_pct=rate(FRAUD), failure_rate_pct=rate(FAILED)),
        "q16_02_vw_fraud_analyst": query(rowwise, columns),
        "q16_03_vw_customer_360": query(
            chain, person, upi_account_count="count(DISTINCT a.upi_id)",
            device_count="count(DISTINCT d.device_id)",
            total_txns=IDS, total_txn_amount=r2(money_sum()),
            avg_txn_amount=money_avg_2dp(), fraud_txns=tally(FRAUD),
            failed_txns=tally("t.status = 'failed'"),
            avg_satisfaction_score=score, last_transaction_date="max(timestamp)"),
    }
    out["q16_01_vw_executive_kpis_by_batch"] = out["q16_01_vw_executive_kpis"]
    return out


COLUMNS = {
    C: {"customer_id": "bigint", "full_name": "string", "mobile_number": "string", "age": "int",
        "gender": "string", "region": "string", "date_joined": "date",
        "is_business_user": "boolean", "risk_score": "double"},
    F: {"feedback_id": "bigint", "customer_id": "bigint", "date_submitted": "date",
        "feedback_text": "string", "satisfaction_score": "int", "issue_type": "string",
        "resolved": "boolean"},
    D: {"device_id": "bigint", "customer_id": "bigint", "device_type": "string",
        "app_version": "string", "is_rooted": "boolean", "last_active": "timestamp_ntz"},
    FA: {"alert_id": "string", "transaction_id": "string", "alert_type": "string",
         "alert_date": "timestamp_ntz", "resolved": "boolean",
         "resolution_date": "timestamp_ntz", "remarks": "string"},
    M: {"merchant_id": "bigint", "merchant_name": "string", "merchant_type": "string",
        "region": "string", "onboard_date": "date", "risk_score": "double"},
    A: {"upi_id": "bigint", "customer_id": "bigint", "bank_name": "string",
        "account_type": "string", "date_added": "date", "status": "string"},
    T: {"transaction_id": "string", "upi_id": "bigint", "customer_id": "bigint",
        "timestamp": "timestamp_ntz", "amount": "double", "transaction_type": "string",
        "merchant_id": "bigint", "counterparty_upi": "string", "status": "string",
        "device_id": "bigint", "device_type": "string", "channel": "string",
        "fraud_flag": "boolean", "reversal_flag": "boolean", "failure_reason": "string"},
}


def _profiles() -> dict[str, str]:
    out = {}

    def nulls(table, column):
        return f"(SELECT count(*) FROM {table} WHERE {column} IS NULL)"

    for table, columns in COLUMNS.items():
        cells = " + ".join(nulls(table, c) for c in columns)
        out[f"e10_null_cells_{table}"] = (
            f"SELECT '{table}' AS table_name, (SELECT count(*) FROM {table}) AS row_count,"
            f" {cells} AS null_cells")
        out[f"e20_preview_{table}"] = (
            f"SELECT * FROM {table} ORDER BY {KEYS[table]} LIMIT 10")
        out[f"e21_profile_{table}"] = _union(*[
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, '{kind}' AS data_type,"
            f" (SELECT count({c}) FROM {table}) AS non_null_count,"
            f" {nulls(table, c)} AS null_count" for c, kind in columns.items()])
    for table in (FA, T):
        out[f"e22_nulls_{table}"] = _union(*[
            f"SELECT '{c}' AS column_name, {nulls(table, c)} AS null_count"
            for c in COLUMNS[table]])
    out["e23_status_frequencies"] = query(T, ["status"], "status IS NOT NULL", value_count=ROWS)
    out["e24_status_where_reason_given"] = query(
        T, ["status"], "failure_reason IS NOT NULL", value_count=ROWS)
    out["e24_resolved_where_no_date"] = query(
        FA, ["resolved"], "resolution_date IS NULL", value_count=ROWS)
    out["e25_null_merchants_by_type"] = query(
        T, ["transaction_type"], null_merchant_ids=tally("merchant_id IS NULL"))
    out["e26_text_lengths_fraud_alert"] = _union(*[
        f"SELECT '{c}' AS column_name, CAST((SELECT max(length({c})) FROM {FA}) AS INTEGER)"
        f" AS max_length" for c in ("alert_id", "transaction_id", "alert_type", "remarks")])
    return out


def _intake() -> dict[str, str]:
    """Cleaning returns the table with ids as text; loading twice adds rows once."""
    numbers = {C: 3, F: 4, D: 5, FA: 6, M: 7, A: 8, T: 9}
    out = {}
    for table, columns in COLUMNS.items():
        texts = [f"CAST({c} AS VARCHAR) AS {c}" if c.endswith("_id") else c for c in columns]
        out[f"e{numbers[table]:02d}_clean_{table}"] = f"SELECT {', '.join(texts)} FROM {table}"
    stored = f"(SELECT transaction_id FROM {T} WHERE timestamp < TIMESTAMP '2000-01-01 00:00:00')"
    out["e14_new_transactions"] = (
        f"SELECT * FROM {T} x WHERE NOT EXISTS (SELECT 1 FROM {stored} s"
        " WHERE s.transaction_id IS NOT DISTINCT FROM x.transaction_id)")
    size = {table: f"(SELECT count(*) FROM {table})" for table in COLUMNS}
    none = big("0")
    out["e19_load_from_csv"] = _union(*[
        f"SELECT '{table}' AS table_name, '{action}' AS action, {before} AS rows_before,"
        f" {n} AS rows_incoming, {inserted} AS rows_inserted, {skipped} AS rows_skipped,"
        f" {n} AS rows_after"
        for table, n in size.items()
        for action, before, inserted, skipped in (
            ("fresh", none, n, none), ("unchanged", n, none, n))])
    undated = f"(SELECT count(*) FROM {FA} WHERE resolution_date IS NULL)"
    out["e10_load_quality"] = _union(*[
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, {size[table]} AS rows_incoming,"
        f" (SELECT count(*) FROM {table} WHERE {c} IS NULL) AS null_cells,"
        f" {undated if c == 'resolution_date' else none} AS lost_values"
        for table, columns in COLUMNS.items() for c in columns])
    third = {k: f"(SELECT count(*) FROM {C} WHERE customer_id % 3 = {k})" for k in range(3)}
    named, other = third[0], size[C]
    two, rest = f"({third[0]} + {third[1]})", f"({third[1]} + {third[2]})"
    without = f"({third[0]} + {third[2]})"
    steps = [
        ("2024-06-01", "fresh", none, two, two, none, two, two),
        ("0af3", "appended", two, other, third[2], two, other, two),
        ("2024-06-01", "appended", third[2], named, named, none, without, named),
        ("1e3", "appended", without, other, third[1], without, other, named),
        ("2024-06-01", "unchanged", rest, none, none, none, rest, none),
    ]
    out["e18_batches"] = _union(*[
        f"SELECT {k} AS step, '{batch}' AS batch, '{action}' AS action, {before} AS rows_before,"
        f" {incoming} AS rows_incoming, {inserted} AS rows_inserted, {skipped} AS rows_skipped,"
        f" {after} AS rows_after, {held} AS held_of_repeated"
        for k, (batch, action, before, incoming, inserted, skipped, after, held)
        in enumerate(steps)])
    return out


def bodies() -> dict[str, str]:
    """The statements on the seven tables themselves."""
    found: dict[str, str] = {}
    for part in (_validation, _kpi, _explore, _fraud, _people, _executive, _constraints, _money,
                 _feedback_and_views, _profiles, _intake):
        found |= part()
    return found


def statements() -> dict[str, str]:
    """The statements on the driver's tables, from which the seven are derived."""
    return {name: statement(body) for name, body in bodies().items()}
