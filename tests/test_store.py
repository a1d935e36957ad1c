"""Batches: any name, repeats of any size, and nothing kept of a failed load."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paylens.model import TABLES
from paylens.plans import REPORTS
from paylens.session import shared_folder
from paylens.sources import bucketed, files, manifest, store, zones
from paylens.sources.cleaning import clean, unread
from paylens.sources.csv_folder import read_folder
from paylens.sources.full_load import Invalid, run_load
from paylens.tables import StoredTables, Tables
from test_load import ROWS, write_folder

NAME, TXN, ALERTS = "merchant", "transaction_history", "fraud_alert"


def merchants(spark, *ids):
    rows = [(i, "Shop", "food", "north", None, 0.5) for i in ids]
    return spark.createDataFrame(rows, TABLES[NAME].schema)


def held(spark, folder):
    df = store.read_stored(spark, NAME, f"{folder}/{NAME}")
    return sorted((r.batch_id, r.merchant_id) for r in df.collect()) if df is not None else []


def test_batch_names_are_text(spark, tmp_path):
    folder = str(tmp_path)
    names = ["2024-06-01", "abc", "1", "01", "0af3", "1e3", "a b:c", "true"]
    for k, batch in enumerate(names):
        result = store.load(spark, merchants(spark, f"m{k}"), NAME, folder, batch)
        assert (result.rows_before, result.rows_inserted, result.rows_after) == (k, 1, k + 1)
    assert held(spark, folder) == sorted((b, f"m{k}") for k, b in enumerate(names))


@pytest.mark.parametrize("again, left", [
    (["a"], []), ([], []), (["c"], ["c"]), (["c", "d", "e"], ["c", "d", "e"]), (["a", "z"], ["z"])])
def test_a_repeat_replaces_its_batch(spark, tmp_path, again, left):
    folder = str(tmp_path)
    store.load(spark, merchants(spark, "a", "b"), NAME, folder, "x")
    store.load(spark, merchants(spark, "c"), NAME, folder, "y")
    result = store.load(spark, merchants(spark, *again), NAME, folder, "y")
    assert result.rows_after == result.rows_before + result.rows_inserted == 2 + len(left)
    assert held(spark, folder) == [("x", "a"), ("x", "b")] + [("y", i) for i in left]


# What a load does, one after the other; each may be the one that fails.
STEPS = [("store", "_staged"), ("store", "_nulls"), ("store", "new_rows"), ("store", "_count"),
         ("zones", "write"), ("bucketed", "write"), ("bucketed", "read"),
         ("manifest", "commit"), ("files", "create")]


class Broken(RuntimeError):
    pass


@pytest.mark.parametrize("module, step", STEPS)
def test_a_failure_at_any_step_loses_nothing(spark, tmp_path, monkeypatch, module, step):
    """Before the step and after it; then the same load succeeds."""
    name, folder = "device_info", str(tmp_path)

    def devices(*ids):
        rows = [(i, "c1", "phone", "1", False, datetime(2024, 1, 1 + k)) for k, i in enumerate(ids)]
        return spark.createDataFrame(rows, TABLES[name].schema)

    def rows():
        df = store.read_stored(spark, name, f"{folder}/{name}")
        return sorted((r.batch_id, r.device_id) for r in df.collect())

    store.load(spark, devices("a", "b"), name, folder, "x")
    store.load(spark, devices("c"), name, folder, "y")
    before, version = rows(), manifest.current(spark, f"{folder}/{name}")
    owner = {"store": store, "zones": zones, "bucketed": bucketed, "manifest": manifest,
             "files": files}[module]
    real = getattr(owner, step)
    for late in (False, True):
        def failing(*args, **kwargs):
            if late and module not in ("manifest", "files"):
                real(*args, **kwargs)
            raise Broken(step)

        monkeypatch.setattr(owner, step, failing)
        with pytest.raises(Broken):
            store.load(spark, devices("b", "d"), name, folder, "x")
        monkeypatch.undo()
        assert rows() == before == [("x", "a"), ("x", "b"), ("y", "c")]
        assert manifest.current(spark, f"{folder}/{name}") == version
    result = store.load(spark, devices("b", "d"), name, folder, "x")
    assert (result.rows_before, result.rows_inserted) == (1, 2)
    assert rows() == [("x", "b"), ("x", "d"), ("y", "c")]


def test_a_repeat_that_fails_keeps_the_batch(spark, tmp_path, monkeypatch):
    """The only batch of a table, repeated, with the last step failing."""
    folder = str(tmp_path)
    store.load(spark, merchants(spark, "a"), NAME, folder, "x")
    monkeypatch.setattr(files, "create", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.load(spark, merchants(spark, "b"), NAME, folder, "x")
    monkeypatch.undo()
    assert held(spark, folder) == [("x", "a")]


def test_a_version_that_is_cut_off_does_not_count(spark, tmp_path):
    folder, path = str(tmp_path), f"{tmp_path}/{NAME}"
    store.load(spark, merchants(spark, "a"), NAME, folder, "x")
    whole = files.read(spark, f"{path}/versions/{1:012d}.json")
    for number, text in ((2, ""), (3, whole[:40]), (4, whole[:-2])):
        files.create(spark, f"{path}/versions/{number:012d}.json", text)
    assert manifest.current(spark, path).number == 1
    store.load(spark, merchants(spark, "b"), NAME, folder, "y")
    assert manifest.current(spark, path).number == 5
    assert held(spark, folder) == [("x", "a"), ("y", "b")]


def test_one_of_two_loads_at_once_is_refused(spark, tmp_path):
    folder, path = str(tmp_path), f"{tmp_path}/{NAME}"
    store.load(spark, merchants(spark, "a"), NAME, folder, "x")
    first = store.prepare(spark, merchants(spark, "b"), NAME, folder, "y")
    second = store.prepare(spark, merchants(spark, "b", "c"), NAME, folder, "z")
    store.commit(spark, first)
    with pytest.raises(store.ConcurrentLoad):
        store.commit(spark, second)
    assert held(spark, folder) == [("x", "a"), ("y", "b")]
    assert not files.exists(spark, f"{path}/data/{second.folder}")
    with pytest.raises(FileExistsError):
        files.create(spark, f"{path}/versions/{1:012d}.json", "again")


def test_a_version_finished_in_between_withdraws_the_later_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    base = manifest.commit(spark, path, manifest.Version(), [manifest.Batch("a", "f", 1)], 8)
    body = files.read(spark, f"{path}/versions/{1:012d}.json")
    files.create(spark, f"{path}/versions/{2:012d}.json", "")  # still being written
    real = files.create

    def create(s, file, text):
        real(s, file, text)
        files.remove(s, f"{path}/versions/{2:012d}.json")
        real(s, f"{path}/versions/{2:012d}.json", body)  # now it is whole

    monkeypatch.setattr(files, "create", create)
    with pytest.raises(store.ConcurrentLoad):
        manifest.commit(spark, path, base, [], 8)
    assert manifest.current(spark, path).number == 2


def test_readers_keep_their_version(spark, tmp_path):
    folder = str(tmp_path)
    for name, table in TABLES.items():
        store.load(spark, spark.createDataFrame([], table.schema), name, folder, "x")
    store.load(spark, merchants(spark, "a"), NAME, folder, "x")
    t = Tables.stored(spark, folder)
    assert t.scan(NAME).count() == 1
    store.load(spark, merchants(spark, "b"), NAME, folder, "x")
    assert [r.merchant_id for r in t.scan(NAME, "merchant_id").collect()] == ["a"]
    assert [r.merchant_id for r in Tables.stored(spark, folder).scan(NAME).collect()] == ["b"]
    assert t.scan("device_info").count() == 0


def test_nothing_is_left_behind(spark, tmp_path):
    folder, staging = str(tmp_path), f"{shared_folder(spark)}/staging"

    def staged():  # of other runs, too: the folder may be shared
        return set(files.children(spark, staging)) if files.exists(spark, staging) else set()

    before = staged()
    for k in range(3):
        store.load(spark, merchants(spark, f"m{k}"), NAME, folder, f"b{k}")
    assert staged() <= before
    assert not [r for r in spark.catalog.listTables() if r.name.startswith("paylens_")]
    for part in ("data", "keys"):
        assert len(files.children(spark, f"{folder}/{NAME}/{part}")) == 3


def test_clean_up(spark, tmp_path):
    folder = str(tmp_path)
    for k in range(3):
        store.load(spark, merchants(spark, f"m{k}"), NAME, folder, "x")
    store.load(spark, merchants(spark, "n"), NAME, folder, "y")
    assert store.clean_up(spark, folder, NAME) == 0  # too young
    assert store.clean_up(spark, folder, NAME, older_than_hours=-1) == 2
    assert held(spark, folder) == [("x", "m2"), ("y", "n")]
    assert len(files.children(spark, f"{folder}/{NAME}/versions")) == 1
    result = store.load(spark, merchants(spark, "m2", "o"), NAME, folder, "z")
    assert result.rows_inserted == 1


def test_batches_of_an_earlier_layout_are_not_overlooked(spark, tmp_path):
    merchants(spark, "a").write.parquet(f"{tmp_path}/{NAME}/batch_id=x")
    with pytest.raises(ValueError, match="without versions"):
        store.load(spark, merchants(spark, "a"), NAME, str(tmp_path), "x")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above(text, node, top):
    """The lines of a plan from ``node`` up to the first ``top``."""
    lines = text.split("\n")
    at = next(i for i, line in enumerate(lines) if node in line)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            found.append(line)
            depth = indent
            if top in line:
                return found
    raise AssertionError(f"no {top} above {node}")


@pytest.mark.parametrize("buckets", [4, 8, 20])
def test_stored_keys_are_never_shuffled(spark, tmp_path, buckets):
    """Whether there are fewer or more buckets than partitions of a shuffle."""
    folder, path = str(tmp_path), f"{tmp_path}/{NAME}"
    for k in range(2):
        store.load(spark, merchants(spark, *[f"m{k}{i}" for i in range(50)], None), NAME, folder,
                   f"b{k}", buckets=buckets)
    version = manifest.current(spark, path)
    assert version.buckets == buckets
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = store._stored_keys(spark, TABLES[NAME], path, list(version.batches), buckets)
        batch = merchants(spark, "m01", "new", "new", None, None)
        fresh = store.new_rows(batch, keys, "merchant_id", True, buckets)
        text = plan(fresh)
        assert sorted(r.merchant_id for r in fresh.collect()) == ["new", "new"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert f"SelectedBucketsCount: {buckets} out of {buckets}" in text
    assert not [line for line in above(text, "FileScan", "SortMergeJoin") if "Exchange" in line]


@pytest.mark.parametrize("stored_null", [False, True])
def test_new_rows_with_and_without_a_stored_null(spark, stored_null):
    kind = "merchant_id string, merchant_name string"
    stored = spark.createDataFrame([("m1",)] + [(None,)] * stored_null, "merchant_id string")
    batch = spark.createDataFrame([("m1", "x"), (None, "y"), ("m2", "z"), (None, "w")], kind)
    wanted = ["z"] if stored_null else ["w", "y", "z"]
    for known in (None, stored_null):
        fresh = store.new_rows(batch, stored, "merchant_id", known)
        assert sorted(r.merchant_name for r in fresh.collect()) == wanted


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def devices(spark, first, days):
    begin = datetime(2024, 1, 1) + timedelta(first)
    rows = [(f"d{first}-{k}", "c1", "phone", "1", False, begin + timedelta(k))
            for k in range(days)]
    return spark.createDataFrame(rows + [(f"n{first}", "c1", "phone", "1", False, None)],
                                 TABLES["device_info"].schema)


def opened(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


def test_only_files_that_overlap_are_opened(spark, tmp_path, uncoalesced):
    """Three loads of a hundred days each, eight files per load."""
    name, folder = "device_info", str(tmp_path)
    for name_, table in TABLES.items():
        if name_ != name:
            spark.createDataFrame([], table.schema).write.parquet(f"{folder}/{name_}")
    for k in range(3):
        store.load(spark, devices(spark, 100 * k, 100), name, folder, f"b{k}")
    t = Tables.stored(spark, folder)
    whole = t.scan(name)
    moments = {}
    for r in whole.selectExpr("_metadata.file_name AS f", "last_active").collect():
        moments.setdefault(r.f, []).append(r.last_active)
    assert len(moments) >= 18 and len(opened(whole)) == len(moments)
    for since, until in ((250, None), (None, 20), (90, 110), (299, 299), (150, 40)):
        low, high = (None if d is None else datetime(2024, 1, 1) + timedelta(d)
                     for d in (since, until))
        part = t.within(name, "last_active", low and f"TIMESTAMP_NTZ '{low}'",
                        high and f"TIMESTAMP_NTZ '{high}'").scan(name)

        def inside(m):
            return m is not None and (not low or m >= low) and (not high or m <= high)

        wanted = {f for f, held in moments.items() if any(map(inside, held))}
        assert wanted <= opened(part) and len(opened(part)) <= len(wanted) + 1
        assert len(opened(part)) < len(moments)
        kept = sorted(r.device_id for r in part.collect() if inside(r.last_active))
        assert kept == sorted(r.device_id for r in whole.collect() if inside(r.last_active))
    assert opened(t.within(name, "app_version").scan(name)) == opened(whole)
    stale = REPORTS["q8_04_stale_devices"](t, as_of="2024-04-01", days=60)
    assert stale.first()[0] == 31


def stored_pair(spark, folder):
    """Transactions of 90 days and their alerts in two batches; the other tables empty."""
    for name, table in TABLES.items():
        if name not in (TXN, ALERTS):
            spark.createDataFrame([], table.schema).write.parquet(f"{folder}/{name}")
    for k in range(2):
        txns = spark.range(300 * k, 300 * (k + 1)).selectExpr(
            "concat('t', id) AS transaction_id", "'u' AS upi_id",
            "concat('c', id % 7) AS customer_id",
            "timestampadd(DAY, CAST(id % 90 AS INT), TIMESTAMP_NTZ'2024-01-01') AS timestamp",
            "1.5D AS amount", "'send' AS transaction_type", "CAST(NULL AS STRING) AS merchant_id",
            "'x' AS counterparty_upi", "'success' AS status", "concat('d', id % 3) AS device_id",
            "'phone' AS device_type", "'app' AS channel", "id % 5 = 0 AS fraud_flag",
            "false AS reversal_flag", "CAST(NULL AS STRING) AS failure_reason")
        alerts = txns.where("fraud_flag").selectExpr(
            "concat('a', transaction_id) AS alert_id", "transaction_id", "'v' AS alert_type",
            "timestamp AS alert_date", "true AS resolved", "timestamp AS resolution_date",
            "CAST(NULL AS STRING) AS remarks")
        # One transaction has most of the alerts.
        more = spark.range(200).selectExpr(
            f"concat('b{k}', id) AS alert_id", "'t0' AS transaction_id", "'v' AS alert_type",
            "TIMESTAMP_NTZ'2024-01-01' AS alert_date", "false AS resolved",
            "CAST(NULL AS TIMESTAMP_NTZ) AS resolution_date", "CAST(NULL AS STRING) AS remarks")
        store.load(spark, txns, TXN, folder, f"b{k}")
        store.load(spark, alerts.unionAll(more), ALERTS, folder, f"b{k}")
    return Tables.stored(spark, folder)


# Reports that join transactions and alerts, and how often they scan the two.
PAIRED = ["q5_09_fraud_by_day_part", "q5_11_flagged_and_alerted", "q9_02_customers_needing_action",
          "q16_02_vw_fraud_analyst"]


def test_stored_transactions_and_alerts_meet_without_a_shuffle(spark, tmp_path):
    t = stored_pair(spark, str(tmp_path))
    plain = Tables({name: t.scan(name) for name in TABLES})
    for name in PAIRED:
        ours, theirs = (sorted(map(str, REPORTS[name](x).collect())) for x in (t, plain))
        assert ours == theirs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in PAIRED:
            text = plan(REPORTS[name](t))
            for table in ("fraud_flag", "alert_id"):
                node = next(line for line in text.split("\n")
                            if "FileScan" in line and f"{table}#" in line.split("Batched")[0])
                assert "Bucketed: true" in node
                at = node.split("[", 1)[0].strip(" :+-") + "[" + node.split("[", 1)[1][:60]
                met = "HashAggregate" if name.startswith("q5_11") else "Join"
                assert not [x for x in above(text, at, met) if "Exchange" in x]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


def test_a_report_on_stored_transactions_opens_the_months_it_needs(spark, tmp_path):
    t = stored_pair(spark, str(tmp_path))
    months = {f.rsplit("month_=", 1)[1][:6] for f in t.scan(TXN).inputFiles()}
    assert months == {"202401", "202402", "202403"}
    recent = t.within(TXN, "timestamp", "TIMESTAMP_NTZ'2024-03-05'")
    assert {f.rsplit("month_=", 1)[1][:6] for f in recent.scan(TXN).inputFiles()} == {"202403"}
    daily = REPORTS["q3_04_daily_volume"]
    plain = Tables({name: t.scan(name) for name in TABLES})
    made = daily(t, as_of="2024-03-28", days=20)
    assert {f.rsplit("month_=", 1)[1][:6] for f in made.inputFiles()} == {"202403"}
    assert made.collect() == daily(plain, as_of="2024-03-28", days=20).collect()
    assert t.scan(TXN).columns == TABLES[TXN].names


def test_more_buckets_do_not_make_more_files_a_year(spark, tmp_path):
    """Four years of transactions in 40 buckets: stretches of six months, named by the first."""
    txns = spark.range(20_000).selectExpr(
        "concat('t', id) AS transaction_id", "'u' AS upi_id", "'c' AS customer_id",
        "CASE WHEN id > 0 THEN timestampadd(DAY, CAST(id % 1461 AS INT),"
        " TIMESTAMP_NTZ'2021-01-01') END AS timestamp",
        "1.5D AS amount", "'send' AS transaction_type", "CAST(NULL AS STRING) AS merchant_id",
        "'x' AS counterparty_upi", "'success' AS status", "'d' AS device_id",
        "'phone' AS device_type", "'app' AS channel", "false AS fraud_flag",
        "false AS reversal_flag", "CAST(NULL AS STRING) AS failure_reason")
    folder = str(tmp_path)
    store.load(spark, txns, TXN, folder, "x", buckets=40)
    rows = store.read_stored(spark, TXN, f"{folder}/{TXN}")
    files_ = rows.inputFiles()
    assert len(files_) <= 4 * 96 + 1
    assert {f.rsplit("month_=", 1)[1].split("/")[0] for f in files_} == {
        "__HIVE_DEFAULT_PARTITION__", *(f"{y}{m}" for y in range(2021, 2025) for m in ("01", "07"))}
    assert rows.select("transaction_id", "timestamp").exceptAll(
        txns.select("transaction_id", "timestamp")).count() == 0 and rows.count() == 20_000
    since = datetime(2024, 10, 1)
    part = store.read_stored(spark, TXN, f"{folder}/{TXN}", zones.Span(since, None))
    assert {f.rsplit("month_=", 1)[1][:6] for f in part.inputFiles()} == {"202407"}
    recent = [df.where(F.col("timestamp") >= F.lit(since).cast("timestamp_ntz")).count()
              for df in (rows, part)]
    assert recent[0] == recent[1] > 0


def test_stretches_of_months():
    assert [bucketed.stretch_months(n) for n in (1, 8, 9, 20, 40, 96, 97, 600, 1000)] == [
        1, 1, 2, 3, 6, 12, 24, 84, 132]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_spans_of_dates_in_any_time_zone(spark, tmp_path, uncoalesced, zone):
    """The day of a boundary is inside, wherever the session is."""
    name, folder = "customer_feedback", str(tmp_path)
    rows = spark.range(60).selectExpr(
        "concat('f', id) AS feedback_id", "'c' AS customer_id",
        "date_add(DATE'2024-01-01', CAST(id AS INT)) AS date_submitted", "'x' AS feedback_text",
        "3 AS satisfaction_score", "'delay' AS issue_type", "false AS resolved")
    for k, low in enumerate((0, 30)):
        store.load(spark, rows.where(f"CAST(substr(feedback_id, 2) AS INT) >= {low}"), name,
                   folder, f"b{k}")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        t = StoredTables(spark, folder)
        for since, until, days in (("2024-02-20", None, 10), (None, "2024-01-03", 3),
                                   ("2024-01-31", "2024-01-31", 1)):
            part = t.within(name, "date_submitted", since and f"TIMESTAMP_NTZ'{since}'",
                            until and f"TIMESTAMP_NTZ'{until}'").scan(name)
            test = " AND ".join(filter(None, (
                since and f"date_submitted >= '{since}'", until and f"date_submitted <= '{until}'")))
            assert part.where(test).count() == days
            assert len(opened(part)) < len(opened(t.scan(name)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_moment_with_most_rows_is_spread(spark, tmp_path, uncoalesced):
    name, folder = "device_info", str(tmp_path)
    rows = [(f"d{k}", "c1", "phone", "1", False, datetime(2024, 1, 1)) for k in range(4000)]
    store.load(spark, spark.createDataFrame(rows, TABLES[name].schema), name, folder, "x")
    df = store.read_stored(spark, name, f"{folder}/{name}")
    sizes = [r.n for r in df.groupBy("_metadata.file_name").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 2 and max(sizes) < 2000


def test_nulls_and_lost_dates_of_a_load(spark, tmp_path):
    folder = write_folder(tmp_path / "in")
    for batch in ("1", "2"):  # counted of the incoming rows, stored or not
        results = {r.table_name: r for r in run_load(spark, folder, str(tmp_path / "out"), batch)}
        assert results["fraud_alert"].lost == {"resolution_date": 1}
        assert results["fraud_alert"].nulls["resolution_date"] == 1
        assert results["fraud_alert"].nulls["remarks"] == 2
        assert results["customer_feedback"].nulls["feedback_text"] == 1
    lines = store.quality_report(spark, list(results.values()))
    assert lines.where("lost_values > 0").count() == 1
    assert lines.count() == sum(len(t.columns) for t in TABLES.values())


def test_an_error_in_one_table_commits_none(spark, tmp_path):
    out = str(tmp_path / "out")
    run_load(spark, write_folder(tmp_path / "in"), out, "1")
    before = {n: manifest.current(spark, f"{out}/{n}").number for n in TABLES}
    more = [*ROWS["upi_account_details"], "u3,c2,B1,savings,2023-01-01,active"]
    bad = [*ROWS["upi_transaction_history"], "t9,u1,c1,no date,1,send,,u9,x,d1,p,w,False,False,"]
    folder = write_folder(tmp_path / "bad", upi_account_details=more, upi_transaction_history=bad)
    with pytest.raises(Exception, match="timestamp"):
        run_load(spark, folder, out, "2")
    assert {n: manifest.current(spark, f"{out}/{n}").number for n in TABLES} == before
    assert all(len(files.children(spark, f"{out}/{n}/data")) == 1 for n in TABLES)


def test_parts_with_other_columns_stop(spark, tmp_path):
    part = tmp_path / "merchant_info.csv"
    part.mkdir()
    (part / "1.csv").write_text("merchant_id,merchant_type,region\nm1,food,north\n")
    (part / "2.csv").write_text("merchant_id,region,merchant_type\nm2,south,toys\n")
    rows = read_folder(spark, str(tmp_path))["merchant_info"].collect()
    assert {(r.merchant_id, r.region) for r in rows} == {("m1", "north"), ("m2", "south")}
    (part / "3.csv").write_text("merchant_id,region\nm3,south\n")
    with pytest.raises(Exception, match="header"):
        read_folder(spark, str(tmp_path))["merchant_info"].collect()


def test_free_text_is_split_on_request(spark, tmp_path):
    stem = "fraud_alert_history"
    folder = write_folder(tmp_path / "in")
    assert read_folder(spark, folder, plain=[stem])[stem].count() == 2
    broken = write_folder(tmp_path / "bad", **{stem: [
        *ROWS[stem], 'a3,t1,velocity,2024-03-01 00:59:00,True,,"two', 'lines"']})
    with pytest.raises(Exception):
        read_folder(spark, broken, plain=[stem])[stem].collect()


def test_dates_in_given_formats(spark):
    names = TABLES["fraud_alert"].names
    raw = spark.createDataFrame([
        ("a1", "t1", "v", "01/16/2024 11:00", "True", "01/17/2024 12:30", None),
        ("a2", "t1", "v", "2024-01-16 11:00:00", "True", "never", None),
        ("a3", "t1", "v", "2024-01-16 11:00:00", "False", "NA", None)],
        ", ".join(f"`{n}` string" for n in names))
    formats = {c: ["MM/dd/yyyy HH:mm"] for c in ("alert_date", "resolution_date")}
    got = clean("fraud_alert", raw, formats=formats).orderBy("alert_id").collect()
    assert [str(r.resolution_date) for r in got] == ["2024-01-17 12:30:00", "None", "None"]
    assert str(got[0].alert_date) == "2024-01-16 11:00:00"
    assert [tuple(r) for r in unread("fraud_alert", raw, formats).collect()] == [
        ("resolution_date", 1)]
    assert unread("fraud_alert", raw).first().lost == 2
    assert unread("merchant", merchants(spark)).count() == 0


def test_validation_before_the_load(spark, tmp_path):
    good, out = write_folder(tmp_path / "good"), str(tmp_path / "out")
    run_load(spark, good, out, "1", validate="report")
    orphan = "t3,u1,c9,2024-03-02 00:30:00,-4,send,,u9,success,d1,phone,web,False,False,"
    bad = write_folder(tmp_path / "bad", upi_transaction_history=[
        *ROWS["upi_transaction_history"], orphan])
    with pytest.raises(Invalid, match="customer_id -> customer_details"):
        run_load(spark, bad, out, "2", validate="stop")
    with pytest.warns(UserWarning, match="amount not negative: 1"):
        results = run_load(spark, bad, out, "2", validate="report")
    assert {r.table_name: r.rows_inserted for r in results}["transaction_history"] == 1
    with pytest.raises(ValueError):
        run_load(spark, good, out, "3", validate="maybe")
