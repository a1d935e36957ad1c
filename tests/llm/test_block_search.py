import math
import random

import pytest

import __spark_entry__ as driver
from compare import connect, difference
from paylens.llm.block_search import top_products

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    known = []
    for vec_id, v, _ in rows:
        if vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v):
            known.append((vec_id, tuple(math.floor(256 * x) for x in v)))
    out = []
    for q, v in sorted(set(known)):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in known
                            if c != q and len(w) == len(v))
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(seed, count, dim=6):
    rnd = random.Random(seed)
    return [(i, [float(rnd.randint(-512, 512)) / 512 for _ in range(dim)], i % 3)
            for i in range(count)]


def check(spark, rows, every=5, k=5):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rank", "2 AS block")
    got = top_products(df, every, k).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == brute(rows, every, k)


def test_random_vectors(spark):
    check(spark, vectors(1, 1500), every=50)


def test_ties_and_hot_vector(spark):
    rows = [(i, [0.5, 0.25], 0) for i in range(1300)] + [(5000 + i, [0.5, -0.1], 0)
                                                         for i in range(40)]
    check(spark, rows, every=100)


@pytest.mark.parametrize("count", [0, 1, 2, 4])
def test_few_rows(spark, count):
    check(spark, vectors(2, count), every=1)


def test_awkward_vectors(spark):
    rows = vectors(3, 30) + [
        (50, None, 0), (55, [], 0), (60, [None, 1.0, 0.0, 0.0, 0.0, 0.0], 0),
        (65, [math.nan] * 6, 0), (70, [math.inf] + [0.0] * 5, 0), (None, [1.0] * 6, 0),
        (75, [0.3, 0.1], None), (76, [0.2, -0.1], None), (80, [0.001] * 6, 1),
        (5, [1.0] * 6, 0), (10, [0.5] * 6, 0), (10, [0.5] * 6, 0), (-5, [0.25] * 6, 0)]
    check(spark, rows)


def test_equals_sql(spark):
    folder, name = "/root/testdata/sf0.01", "op7_block_search"
    con = connect(folder)
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    found = driver.queries()[name](spark, folder)
    assert difference(found, con, driver.oracle_sql()[name]) is None
