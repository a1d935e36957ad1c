"""Reading, cleaning and loading CSV folders."""

import pytest
from pyspark.sql import functions as F

from paylens.model import TABLES
from paylens.plans.profile import preview
from paylens.plans.views import register_views, write_views
from paylens.sources import store
from paylens.sources.cleaning import clean
from paylens.sources.csv_folder import as_tables, read_folder
from paylens.sources.full_load import LOAD_ORDER, run_load
from paylens.tables import Tables

ROWS = {
    "customer_master": [
        "customer_id,full_name,mobile_number,age,gender,region,date_joined,is_business_user,"
        "risk_score",
        "c1,Ann,911,30,F,north,2024-01-31,True,0.2",
        "c2,Bob,912,25.0,M,south,2024-02-01,False,0.9",
    ],
    "customer_feedback_surveys": [
        "feedback_id,customer_id,date_submitted,feedback_text,satisfaction_score,issue_type,"
        "resolved",
        'f1,c1,2024-03-01,"two\nlines, and ""quotes""",2,delay,False',
        "f2,c1,2024-03-02,NA,5,delay,True",
    ],
    "device_info": [
        "device_id,customer_id,device_type,app_version,is_rooted,last_active",
        "d1,c1,phone,1.0,True,2024-03-01 10:00:00",
    ],
    "fraud_alert_history": [
        "alert_id,transaction_id,alert_type,alert_date,resolved,resolution_date,remarks",
        "a1,t1,velocity,2024-03-01 00:59:00,True,2024-03-01 01:01:00,",
        "a2,t1,velocity,2024-03-01 00:59:00,False,unknown,",
    ],
    "merchant_info": [
        "merchant_id,merchant_name,merchant_type,region,onboard_date,risk_score",
        "m1,Shop,food,north,2023-05-05,0.1",
    ],
    "upi_account_details": [
        "upi_id,customer_id,bank_name,account_type,date_added,status",
        "u1,c1,B1,savings,2023-01-01,active", "u2,c1,B2,current,2023-01-02,blocked",
    ],
    "upi_transaction_history": [
        "transaction_id,upi_id,customer_id,timestamp,amount,transaction_type,merchant_id,"
        "counterparty_upi,status,device_id,device_type,channel,fraud_flag,reversal_flag,"
        "failure_reason",
        "t1,u1,c1,2024-03-01 00:30:00,10.5,send,,u9,success,d1,phone,app,True,False,",
        "t2,u1,c1,2024-03-02 00:30:00,20.25,bill_pay,m1,u9,failed,d1,phone,web,False,False,timeout",
    ],
}


def write_folder(path, **changed):
    path.mkdir()
    for stem, lines in {**ROWS, **changed}.items():
        (path / f"{stem}.csv").write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def folder(tmp_path):
    return write_folder(tmp_path / "in")


def test_missing_and_empty_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_folder(spark, str(tmp_path / "nowhere"))
    (tmp_path / "bare").mkdir()
    with pytest.warns(UserWarning):
        assert read_folder(spark, str(tmp_path / "bare")) == {}
    with pytest.raises(KeyError):
        as_tables({})


def test_cleaning_types_and_missing_markers(spark, folder):
    raw = as_tables(read_folder(spark, folder))
    for name, table in TABLES.items():
        assert clean(name, raw[name]).schema == table.schema
    feedback = {r.feedback_id: r for r in clean("customer_feedback",
                                                raw["customer_feedback"]).collect()}
    assert feedback["f1"].feedback_text == 'two\nlines, and "quotes"'
    assert feedback["f2"].feedback_text is None
    assert [r.age for r in clean("customer_details", raw["customer_details"])
            .orderBy("customer_id").collect()] == [30, 25]
    alerts = clean("fraud_alert", raw["fraud_alert"]).orderBy("alert_id").collect()
    assert alerts[0].resolution_date is not None and alerts[1].resolution_date is None


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_unreadable_date_stops(spark, tmp_path, ansi):
    bad = ROWS["merchant_info"][:1] + ["m1,Shop,food,north,some day,0.1"]
    raw = as_tables(read_folder(spark, write_folder(tmp_path / "in", merchant_info=bad)))
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="onboard_date"):
            clean("merchant", raw["merchant"]).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_malformed_line_stops(spark, tmp_path):
    bad = ROWS["merchant_info"] + ["m2,Shop,food,north,2023-05-05,0.1,extra,extra"]
    raw = as_tables(read_folder(spark, write_folder(tmp_path / "in", merchant_info=bad)))
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        clean("merchant", raw["merchant"]).collect()


def test_defaults_are_filled_on_request(spark):
    text = ", ".join(f"{c} string" for c in TABLES["device_info"].names)
    raw = spark.createDataFrame([("d1", "c1", "phone", "1", None, "2024-01-01")], text)
    assert clean("device_info", raw).head().is_rooted is None
    assert clean("device_info", raw, fill_defaults=True).head().is_rooted is False


def test_load_twice_adds_rows_once(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    first = run_load(spark, folder, out, "b1")
    assert [r.table_name for r in first] == list(LOAD_ORDER)
    assert {r.action for r in first} == {"fresh"}
    second = run_load(spark, folder, out, "b2")
    assert {r.action for r in second} == {"unchanged"}
    assert all(r.rows_inserted == 0 and r.rows_after == r.rows_before for r in second)

    more = ROWS["upi_transaction_history"] + [
        line.replace("t2,", "t3,", 1) for line in ROWS["upi_transaction_history"][2:]]
    third = run_load(
        spark, write_folder(tmp_path / "in2", upi_transaction_history=more), out, "b3")
    txns = third[-1]
    assert (txns.action, txns.rows_before, txns.rows_inserted, txns.rows_skipped,
            txns.rows_after) == ("appended", 2, 1, 2, 3)
    # Repeating a batch replaces what it wrote.
    again = run_load(spark, str(tmp_path / "in2"), out, "b3")[-1]
    assert (again.rows_inserted, again.rows_after) == (1, 3)

    stored = Tables.stored(spark, out)
    assert stored.scan("transaction_history").schema == TABLES["transaction_history"].schema
    raw = store.read_stored(spark, "transaction_history", f"{out}/transaction_history")
    assert raw.where(F.col("uploaded_at").isNull()).count() == 0
    assert [r.transaction_id for r in preview(stored, "transaction_history", 2).collect()] == [
        "t1", "t2"]
    stored.register()
    register_views(stored)
    assert spark.sql("SELECT count(*) AS n FROM transaction_history").head().n == 3
    assert spark.sql("SELECT sum(total_txns) AS n FROM vw_executive_kpis").head().n == 3
    write_views(stored, str(tmp_path / "views"))
    assert spark.read.parquet(str(tmp_path / "views/vw_fraud_analyst")).count() == 4


def test_repeated_and_null_keys(spark, tmp_path):
    kind = "merchant_id string, merchant_name string"
    stored = spark.createDataFrame([("m1", "a"), (None, "b")], kind)
    batch = spark.createDataFrame([("m1", "x"), (None, "y"), ("m2", "z"), ("m2", "z2")], kind)
    fresh = store.new_rows(batch, stored.select("merchant_id"), "merchant_id")
    assert sorted(r.merchant_name for r in fresh.collect()) == ["z", "z2"]

    full = clean("merchant", spark.createDataFrame(
        [("m1", "a", "t", "r", "2024-01-01", "0.1")] * 2,
        ", ".join(f"{c} string" for c in TABLES["merchant"].names)))
    kept = store.load(spark, full, "merchant", str(tmp_path / "kept"), "b")
    assert kept.rows_after == 2
    single = store.load(spark, full, "merchant", str(tmp_path / "one"), "b", dedupe_batch=True)
    assert single.rows_after == 1


def test_count_mismatch_is_raised(spark, tmp_path, monkeypatch):
    full = clean("merchant", spark.createDataFrame(
        [("m1", "a", "t", "r", "2024-01-01", "0.1")],
        ", ".join(f"{c} string" for c in TABLES["merchant"].names)))
    monkeypatch.setattr(store, "_count", lambda *_: 5)
    with pytest.raises(store.CountMismatch):
        store.load(spark, full, "merchant", str(tmp_path / "out"), "b")
