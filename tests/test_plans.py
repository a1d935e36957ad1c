"""What the physical plans may and may not contain."""

import re

import pytest

from paylens.operators.sizing import fits_broadcast
from paylens.model import TABLES
from paylens.plans import REPORTS
from paylens.sources.sample_tables import CLOCKS, SampleTables
from paylens.tables import Tables

FOLDER = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas")
# Their windows run over a histogram of bounded size or over calendar months.
ONE_TASK_WINDOW = ("p1_", "q5_06", "q14_08", "q9_06")
LOADS = ("e10_load_quality", "e18_batches", "e19_load_from_csv",
         "q16_01_vw_executive_kpis_by_batch")
NAMES = sorted(name for name in REPORTS if name not in LOADS)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return SampleTables(spark, FOLDER)


def build(name, tables):
    return REPORTS[name](tables, CLOCKS.get(REPORTS[name].clock))


@pytest.mark.parametrize("name", NAMES)
def test_no_forbidden_operator(name, tables):
    text = plan(build(name, tables))
    assert not [word for word in FORBIDDEN if word in text]
    one_task = re.search(r"windowspecdefinition\((\S+ (ASC|DESC)|specifiedwindowframe)", text)
    assert bool(one_task) == name.startswith(ONE_TASK_WINDOW)


def scanned(text: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<(.*?)>", text)]


def test_only_needed_columns_are_read(tables):
    text = plan(build("q2_03_fraud_rate", tables))
    assert scanned(text) == [{"l_discount"}]
    text = plan(build("q3_09_top_merchants", tables))
    assert {"l_suppkey", "l_returnflag", "l_extendedprice"} in scanned(text)
    assert not any("o_orderkey" in s or "p_partkey" in s for s in scanned(text))


def test_filters_reach_the_scan(spark, tables, tmp_path):
    for name, table in TABLES.items():
        spark.createDataFrame([], table.schema).write.parquet(str(tmp_path / name))
    stored = Tables.stored(spark, str(tmp_path))
    text = plan(build("q13_02_largest_pending", stored))
    assert re.search(r"PushedFilters: \[.*EqualTo\(status,pending\)", text)
    assert {"customer_id", "amount", "transaction_id", "status"} in scanned(text)
    text = plan(build("q3_04_daily_volume", stored))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(timestamp,2001-10-06", text)
    text = plan(build("q16_02_vw_fraud_analyst", tables))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(l_discount,0.095\)", text)


def test_small_lookup_is_broadcast_and_fact_not_shuffled(tables):
    text = plan(build("q3_08_by_merchant_type", tables))
    assert "SortMergeJoin" not in text
    text = plan(build("q7_01_failures_by_region", tables))
    assert text.count("BroadcastHashJoin") >= 1
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_large_lookup_meets_reduced_facts(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not fits_broadcast(tables.scan("merchant", "merchant_id"))
        text = plan(build("q7_01_failures_by_region", tables))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    join = text.index("SortMergeJoin [merchant_id")
    assert "HashAggregate(keys=[merchant_id" in text[join:]
    assert "Broadcast" not in text


def test_top_per_group_limits_before_the_shuffle(tables):
    assert "WindowGroupLimit" in plan(build("q7_04_top_merchants_by_region", tables))


def test_top_k_needs_no_global_sort(tables):
    assert "TakeOrderedAndProject" in plan(build("q3_10_top_customers", tables))


def test_distinct_counts_without_expand(tables):
    for name in ("q2_07_retention", "q5_11_flagged_and_alerted"):
        assert "Expand" not in plan(build(name, tables))


@pytest.fixture
def large(spark, tmp_path):
    """Stored tables, none of which may be broadcast."""
    for name, table in TABLES.items():
        spark.createDataFrame([], table.schema).write.parquet(str(tmp_path / name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Tables.stored(spark, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["q16_02_vw_fraud_analyst", "q5_09_fraud_by_day_part"])
def test_transactions_are_read_once(name, large):
    text = plan(build(name, large))
    read = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert sum("transaction_id#" in r and "fraud_flag#" in r for r in read) == 1


def test_day_parts_shuffle_transactions_once(large):
    text = plan(build("q5_09_fraud_by_day_part", large))
    assert len(re.findall(r"hashpartitioning\(transaction_id", text)) == 2  # and the alerts


def test_all_checks_of_a_table_share_a_shuffle(large):
    for name in ("q9_07_data_quality", "q1_04_orphan_txn_customer"):
        text = plan(build(name, large))
        assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
        assert "Join" not in text


def test_the_key_of_a_table_travels_as_a_hash(large):
    for name in ("q10_05_constraints_transaction_history", "q1_17_repeated_transaction_id"):
        df = build(name, large)
        text = df._jdf.queryExecution().toString() if name.startswith("q10") else plan(df)
        text = text[text.index("Physical Plan"):] if "Physical Plan" in text else text
        shuffles = re.findall(r"Exchange hashpartitioning\((\w+)", text)
        assert "hash_" in shuffles
        assert len([s for s in shuffles if s == "tag"]) == name.startswith("q10")


def test_a_preview_reads_wide_columns_of_few_row_groups(spark, tmp_path):
    """Keys rise over many files; only the first file's other columns are needed."""
    rows = spark.range(4000).selectExpr(
        "lpad(CAST(id AS STRING), 8, '0') AS merchant_id", "'s' AS merchant_name",
        "'x' AS merchant_type", "'north' AS region", "DATE'2024-01-01' AS onboard_date",
        "0.5D AS risk_score")
    rows.repartitionByRange(20, "merchant_id").write.parquet(str(tmp_path / "merchant"))
    t = Tables({"merchant": spark.read.parquet(str(tmp_path / "merchant"))})
    df = REPORTS["e20_preview_merchant"](t)
    assert re.search(r"PushedFilters: \[.*LessThanOrEqual\(merchant_id,00000009\)", plan(df))
    assert [r.merchant_id for r in df.collect()] == [f"{k:08d}" for k in range(10)]
    read = [m for m in _metrics(df) if m[0] == "number of output rows"]
    assert 10 <= read[-1][1] <= 1000


def _metrics(df):
    """(name, value) of the metrics of the file scan, after the query has run."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().head()
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        node = node.executedPlan()
        while node.children().size():
            node = node.children().head()
    found, it = [], node.metrics().valuesIterator()
    while it.hasNext():
        m = it.next()
        found.append((m.name().get(), m.value()))
    return found


def test_previews_with_nulls_ties_and_few_rows(spark):
    schema = TABLES["merchant"].schema
    for keys in ([], [None], [None] * 12, ["b", None, "a", "a"], [f"k{k:02d}" for k in range(30)],
                 ["x"] * 15):
        rows = [(k, "s", "t", "r", None, 0.5) for k in keys]
        t = Tables({"merchant": spark.createDataFrame(rows, schema)})
        got = [r.merchant_id for r in REPORTS["e20_preview_merchant"](t).collect()]
        assert got == sorted(keys, key=lambda k: (k is not None, k or ""))[:10]


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_repeated_keys_with_colliding_hashes(spark, bits):
    from paylens.operators.integrity import repeated_keys

    keys = ["a", "b", "b", "c", None, None, None, "d", "e", "e"] + [f"k{k}" for k in range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "id string")
    got = {r.id: r.row_count for r in repeated_keys(df, "id", bits=bits).collect()}
    assert got == {"b": 2, "e": 2, None: 3}


def test_of_a_large_parent_only_wanted_keys_are_shuffled(tables, monkeypatch):
    """Few alerts: their transactions are picked by broadcast before the shuffle."""
    from paylens.operators import audit

    monkeypatch.setattr(audit, "fits_broadcast", lambda df: "Generate" in plan(df))  # alerts
    text = plan(build("q1_09_orphan_alert_txn", tables))
    assert "LeftSemi" in text and len(re.findall(r"hashpartitioning\(tag", text)) == 1


def test_lookup_above_the_threshold_spares_a_wide_table(spark, tables):
    from paylens.operators.joins import small
    from paylens.operators.sizing import WIDE

    owners = tables.scan("customer_details", "customer_id", "full_name")
    plan_ = owners._jdf.queryExecution().optimizedPlan()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    size = int(plan_.collectLeaves().head().stats().sizeInBytes())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(size))
    try:
        assert not fits_broadcast(owners) and fits_broadcast(owners, WIDE)
        assert "broadcast" in small(owners, WIDE)._jdf.queryExecution().logical().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
