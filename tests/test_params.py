"""Parameters, the variants without multiplication, and sums no order can change."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paylens.functions import calendar
from paylens.functions.rates import joined, pct, split_sum
from paylens.operators.percentiles import exact_percentiles
from paylens.plans import REPORTS
from paylens.sources.sample_tables import CLOCKS, SampleTables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return SampleTables(spark, FOLDER)


def test_exact_variants_count_each_row_once(tables):
    whole = tables.scan("transaction_history", "fraud_flag")
    rows = whole.count()
    bands = REPORTS["q5_09_fraud_by_day_part"](tables, exact=True)
    assert bands.agg(F.sum("total_txns")).head()[0] == rows
    profile = REPORTS["q16_03_vw_customer_360"](tables, exact=True)
    assert profile.agg(F.sum("total_txns")).head()[0] == rows
    people = REPORTS["q9_02_customers_needing_action"](tables, exact=True, top=10**6)
    assert people.agg(F.sum("fraud_txns")).head()[0] == whole.where("fraud_flag").count()


def test_thresholds(tables):
    assert REPORTS["q3_09_top_merchants"](tables, top=3).count() == 3
    assert REPORTS["q7_04_top_merchants_by_region"](tables, top=1).count() == 5
    wide = REPORTS["q2_07_retention"](tables, as_of=CLOCKS["transactions"], days=5000).head()
    assert wide.active_last_5000_days == wide.total_customers and wide.retention_rate_pct == 100
    assert REPORTS["q2_07_retention"](tables).head().active_last_90_days == 0


def test_clock_arithmetic(spark):
    def value(sql):
        return spark.range(1).select(F.expr(sql)).head()[0]

    assert value(calendar.hours_crossed("TIMESTAMP_NTZ'2024-01-01 00:59:00'",
                                        "TIMESTAMP_NTZ'2024-01-01 01:01:00'")) == 1
    assert value(calendar.days_crossed("TIMESTAMP_NTZ'2024-01-01 23:59:00'",
                                       "TIMESTAMP_NTZ'2024-01-02 00:01:00'")) == 1
    assert value(calendar.months_before("2024-08-31", 6)) == datetime(2024, 2, 29)
    assert value(calendar.weekday_name("dayofweek(DATE'2024-06-02')")) == "Sunday"


def test_rates_round_half_up(spark):
    df = spark.createDataFrame([(201, 20000), (-201, 20000), (1, 3), (0, 0)], "a long, n long")
    assert [r[0] for r in df.select(F.expr(pct("a", "n"))).collect()] == [1.01, -1.01, 33.33, None]


def test_sums_are_exact_and_do_not_overflow(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.2, -0.3, 1e-4, 8e11, -8e11)], "v double")
    parts = [F.expr(sql).alias(name) for name, sql in split_sum("v", "s", 4).items()]
    assert df.agg(*parts).select(F.expr(joined("s", 4))).head()[0] == 0.0001
    many = spark.range(3_000_000).select(F.lit(9e11).alias("v"))  # 2.7e22 units
    assert many.agg(*parts).select(F.expr(joined("s", 4))).head()[0] == 2.7e18


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [-3.5, -3.5, 0.0, 0.0001, 1023.9999, 1024.0, 1e9], [7.25] * 50 + [None],
    [float(2**k) + d for k in range(40) for d in (-0.0001, 0.0, 0.0001)],
])
def test_percentiles_equal_the_built_in_ones(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wanted = {f"p{i}": i / 7 for i in range(8)}
    mine = exact_percentiles(df, "v", wanted).head()
    theirs = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in wanted.values()]))).head()[0]
    assert list(mine) == pytest.approx(theirs, rel=1e-12)


def test_percentiles_of_nothing(spark):
    row = exact_percentiles(spark.createDataFrame([], "v double"), "v", {"p": 0.5}).head()
    assert row.p is None
