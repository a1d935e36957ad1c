"""Sums and percentiles of amounts that have more decimals, or are larger, than money has."""

import math

import pytest
from pyspark.sql import functions as F

from paylens.functions.rates import joined, joined_mean, split_sum
from paylens.model import TABLES
from paylens.operators.fanout import copies, times
from paylens.operators.percentiles import exact_percentiles
from paylens.plans import REPORTS
from paylens.tables import Tables


def summed(spark, values, digits=4):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    parts = df.agg(F.count("v").alias("c"), *[
        F.expr(f"{sql} AS {name}") for name, sql in split_sum("v", "v", digits).items()])
    return parts.select(F.expr(joined("v", digits)), F.expr(joined_mean("v", digits, "c", 2))).first()


@pytest.mark.parametrize("values", [
    [0.00003] * 1000, [1e-9] * 50 + [2.5], [1e15, 0.25, -3.75], [9.3e14] * 3, [1e300, 1.0],
    [0.07, 0.1, 0.2, None], [-0.00001, 0.00001, 5.0]])
def test_sum_is_not_cut(spark, values):
    known = [v for v in values if v is not None]
    total, mean = summed(spark, values)
    assert total == pytest.approx(math.fsum(known), rel=1e-12, abs=1e-18)
    assert mean == pytest.approx(math.fsum(known) / len(known), abs=0.0050001, rel=1e-9)


def test_money_sums_do_not_depend_on_order(spark):
    values = [round(0.01 * k, 2) for k in range(1, 3000)]
    assert summed(spark, values)[0] == summed(spark, values[::-1])[0] == 44985.0


def test_nothing_and_odd_values(spark):
    assert tuple(summed(spark, [None, None])) == (None, None)
    assert math.isinf(summed(spark, [math.inf, 1.0])[0])
    assert math.isnan(summed(spark, [math.nan, 1.0])[0])


def transactions(spark, amounts):
    schema = TABLES["transaction_history"].schema
    rows = [tuple(f"t{k}" if f.name == "transaction_id" else a if f.name == "amount"
                  else False if f.dataType.typeName() == "boolean" else None
                  for f in schema) for k, a in enumerate(amounts)]
    return Tables({"transaction_history": spark.createDataFrame(rows, schema)})


def test_large_amounts_in_reports(spark):
    t = transactions(spark, [1e15, 2e15, 0.00003, 4.0])
    name = next(n for n in REPORTS if n.startswith("q2_01"))
    found = REPORTS[name](t).first()
    assert found.total_value_inr == 3e15 + 4.00003
    for prefix in ("p1", "q14_08"):
        name = next(n for n in REPORTS if n.startswith(prefix))
        assert REPORTS[name](t).collect()


@pytest.mark.parametrize("values", [
    [1e15, -1e15, 0.0, 1e-9, 2e-9, 3e-9], [5e-324, 1e-310, 1e308], [2.0, 4.0, 8.0, 1.9999999999],
    [math.inf, 1.0, -math.inf], [0.0, -0.0, 0.0], list(map(float, range(500)))])
def test_percentiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_percentiles(df, "v", {"low": 0.0, "mid": 0.5, "high": 1.0}).first()
    ordered = sorted(values)
    place = (len(values) - 1) / 2
    a, b = ordered[math.floor(place)], ordered[math.ceil(place)]
    assert got.low == ordered[0] or math.isnan(got.low)
    assert got.high == ordered[-1] or math.isnan(got.high)
    assert got.mid == pytest.approx(a + (b - a) * (place % 1)) or math.isinf(a) or math.isinf(b)


def test_counts_beyond_a_double(spark):
    df = spark.createDataFrame([(2**53 + 1, 3)], "n long, k long")
    assert df.agg(F.expr(times("n", copies("k")))).first()[0] == 3 * (2**53 + 1)
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        df.agg(F.expr(times("n", copies("k", "n")))).first()
