"""Standard deviations through a lookup, from one row per key."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from paylens.model import TABLES
from paylens.operators.rollup import rollup_around, rollup_through
from paylens.tables import Tables

TXN, CUSTOMERS = "transaction_history", "customer_details"


def tables(spark, amounts):
    """amounts: (customer, amount); the region of customer k is k % 3, NULL for 0."""
    txns = spark.createDataFrame(amounts, "customer_id string, amount double")
    empty = {c.name: F.lit(None).cast(c.type).alias(c.name) for c in TABLES[TXN].columns
             if c.name not in txns.columns}
    owners = spark.createDataFrame(
        [(f"c{k}", f"r{k % 3}" if k % 3 else None) for k in range(40)],
        "customer_id string, region string")
    return Tables({TXN: txns.select("*", *empty.values()), CUSTOMERS: owners})


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")


@pytest.mark.parametrize("base, noise", [(0, 100.0), (1e9, 1.0), (-1e12, 0.5), (1e9, 0.0)])
def test_large_means_do_not_cancel(spark, no_broadcast, base, noise):
    """Regions of very different size, a hot customer, NULL amounts, one-row regions."""
    r = random.Random(3)
    rows = [(f"c{r.choice([1] * 10 + list(range(0, 40)))}", None) for _ in range(3000)]
    rows = [(c, None if r.random() < 0.05 else
             (base if int(c[1:]) % 3 == 1 else 1.0) + r.uniform(-noise, noise)) for c, _ in rows]
    rows = [x for x in rows if int(x[0][1:]) % 3] + [("c0", 5.0), ("c99", 7.0), (None, 8.0)]
    got = {x.region: x for x in rollup_through(
        tables(spark, rows), TXN, CUSTOMERS, "customer_id", ["region"], "rows spread").collect()}
    assert set(got) == {"r1", "r2", None}
    assert got[None].spread is None and got[None].rows == 1
    for region in ("r1", "r2"):
        held = [a for c, a in rows if c and a is not None and f"r{int(c[1:]) % 3}" == region]
        exact = statistics.stdev(held)
        rounding = 4 * math.ulp(max(map(abs, held)))  # of the amounts themselves
        assert got[region].spread == pytest.approx(exact, rel=1e-9, abs=rounding)


def test_both_ways_agree(spark):
    r = random.Random(4)
    t = tables(spark, [(f"c{r.randrange(40)}", r.gauss(50, 20)) for _ in range(2000)])

    def run():
        found = rollup_through(t, TXN, CUSTOMERS, "customer_id", ["region"], "ids spread low")
        return {x.region: (x.ids, round(x.spread, 9), x.low) for x in found.collect()}

    direct = run()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == direct
        plan = rollup_through(t, TXN, CUSTOMERS, "customer_id", ["region"], "spread")
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert "HashAggregate(keys=[customer_id" in text[text.index("SortMergeJoin [customer_id"):]


def test_not_of_left_joined_rows(spark):
    with pytest.raises(ValueError):
        rollup_around(tables(spark, [("c1", 1.0)]), CUSTOMERS, TXN, "customer_id", ["region"],
                      "spread")
