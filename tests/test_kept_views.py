"""Views that are the sum of their shares per batch."""

import pytest
from pyspark.sql import functions as F

from paylens.model import TABLES
from paylens.plans import REPORTS
from paylens.plans import kept_views
from paylens.plans.kept_views import KeptViews, Stale
from paylens.sources import files, store
from paylens.tables import Tables

TXN, CUSTOMERS = "transaction_history", "customer_details"


def people(spark, low, high, region="north"):
    return spark.range(low, high).selectExpr(
        "concat('c', id) AS customer_id", "'n' AS full_name", "'9' AS mobile_number", "30 AS age",
        "'f' AS gender", f"'{region}' AS region", "DATE'2024-01-01' AS date_joined",
        "true AS is_business_user", "0.5D AS risk_score")


def txns(spark, low, high):
    return spark.range(low, high).selectExpr(
        "concat('t', id) AS transaction_id", "'u' AS upi_id",
        "CASE WHEN id % 11 > 0 THEN concat('c', id % 9) END AS customer_id",
        "timestampadd(DAY, CAST(id % 90 AS INT), TIMESTAMP_NTZ'2024-01-01') AS timestamp",
        "CASE WHEN id % 13 > 0 THEN id / 7D END AS amount", "'send' AS transaction_type",
        "CAST(NULL AS STRING) AS merchant_id", "'x' AS counterparty_upi",
        "CASE WHEN id % 4 = 0 THEN 'failed' ELSE 'success' END AS status", "'d' AS device_id",
        "'phone' AS device_type", "concat('ch', id % 2) AS channel", "id % 5 = 0 AS fraud_flag",
        "id % 6 = 0 AS reversal_flag", "CAST(NULL AS STRING) AS failure_reason")


@pytest.fixture
def home(spark, tmp_path):
    folder = str(tmp_path / "tables")
    for name, table in TABLES.items():
        if name not in (TXN, CUSTOMERS):
            spark.createDataFrame([], table.schema).write.parquet(f"{folder}/{name}")
    return folder


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def same(spark, home, views):
    t = Tables.stored(spark, home)
    assert rows(views.executive_kpis()) == rows(REPORTS["q16_01_vw_executive_kpis"](t))
    for exact in (False, True):
        assert rows(views.customer_360(exact)) == rows(
            REPORTS["q16_03_vw_customer_360"](t, exact=exact))


def test_shares_add_up_to_the_views(spark, home, tmp_path, monkeypatch):
    views = KeptViews(spark, home, str(tmp_path / "views"))
    store.load(spark, people(spark, 0, 5), CUSTOMERS, home, "a")
    store.load(spark, txns(spark, 0, 200), TXN, home, "a")
    with pytest.raises(Stale):
        views.executive_kpis()
    assert views.refresh() == Tables.stored(spark, home).loads(TXN)
    same(spark, home, views)
    first = Tables.stored(spark, home).loads(TXN)

    # A second batch is the only one that is scanned.
    store.load(spark, txns(spark, 150, 320), TXN, home, "b")
    read = []
    real = kept_views.read_loads
    monkeypatch.setattr(
        kept_views, "read_loads", lambda *a: read.extend(a[3]) or real(*a))
    scanned = views.refresh()
    assert scanned == read and len(scanned) == 1 and not set(scanned) & set(first)
    monkeypatch.undo()
    same(spark, home, views)
    files_read = {f for f in views.executive_kpis().inputFiles() if f"/{TXN}/" in f}
    assert not files_read and views.refresh() == []

    # New customers find the transactions that came before them; nothing is scanned.
    store.load(spark, people(spark, 5, 8, "south"), CUSTOMERS, home, "b")
    assert views.refresh() == []
    same(spark, home, views)
    assert views.executive_kpis().where("region = 'south'").count() > 0

    # A repeated batch of transactions replaces its share.
    store.load(spark, txns(spark, 160, 260), TXN, home, "b")
    assert len(views.refresh()) == 1
    same(spark, home, views)

    # A repeated batch of customers may have changed regions: all shares are made again.
    store.load(spark, people(spark, 1, 5, "west"), CUSTOMERS, home, "a")
    assert len(views.refresh()) == 2
    same(spark, home, views)
    assert views.executive_kpis().where("region = 'north'").count() == 0

    assert views.clean_up() == 0
    assert views.clean_up(older_than_hours=-1) == 3
    same(spark, home, views)
    assert views.write(str(tmp_path / "out")) == []
    assert rows(spark.read.parquet(str(tmp_path / "out/vw_customer_360"))) == rows(
        views.customer_360())


def test_an_unfinished_share_does_not_count(spark, home, tmp_path, monkeypatch):
    views = KeptViews(spark, home, str(tmp_path / "views"))
    store.load(spark, people(spark, 0, 5), CUSTOMERS, home, "a")
    store.load(spark, txns(spark, 0, 50), TXN, home, "a")
    monkeypatch.setattr(files, "create", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        views.refresh()
    monkeypatch.undo()
    with pytest.raises(Stale):
        views.executive_kpis()
    assert len(views.refresh()) == 1
    same(spark, home, views)
    assert views.clean_up(older_than_hours=-1) == 1


def test_empty_tables(spark, home, tmp_path):
    for name in (TXN, CUSTOMERS):
        store.load(spark, spark.createDataFrame([], TABLES[name].schema), name, home, "a")
    views = KeptViews(spark, home, str(tmp_path / "views"))
    assert views.refresh() == []
    assert views.executive_kpis().count() == views.customer_360().count() == 0


def test_a_customer_twice_counts_twice(spark, home, tmp_path):
    twice = people(spark, 0, 3).unionAll(people(spark, 2, 4, "south"))
    store.load(spark, twice.limit(0), CUSTOMERS, home, "none")
    store.load(spark, txns(spark, 0, 60), TXN, home, "a")
    views = KeptViews(spark, home, str(tmp_path / "views"))
    views.refresh()
    store.load(spark, twice, CUSTOMERS, home, "a")
    assert views.refresh() == []
    same(spark, home, views)
    assert twice.where(F.col("customer_id") == "c2").count() == 2
