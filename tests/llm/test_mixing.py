from collections import Counter

import cases
import pytest

from paylens.llm.mixing import block_slots, cycle_plan, in_mixed_order, mixed


def test_every_row_once(spark):
    docs = cases.frame(spark)
    found = mixed(docs, block=3, cycle=10)
    got = Counter((r.row_.doc_id, r.row_.text) for r in found.collect())
    assert got == Counter((r.doc_id, r.text) for r in docs.collect())
    places = found.groupBy("slot", "place").count().where("count > 1").count()
    assert places == 0


@pytest.mark.parametrize("weights", [
    {"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2},
    {"a": 0.97, "b": 0.02, "c": 0.01}, {"a": 7.0, "b": 5.0, "c": 3.0}])
def test_deviation_below_one_block(spark, weights):
    sizes = spark.createDataFrame([(s, 100) for s in weights], "source string, size long")
    plan = cycle_plan(sizes, weights, 50).collect()
    slots = plan[0].slots
    assert sorted(r.slot for r in plan) == list(range(slots))
    for source in weights:
        own = [r for r in plan if r.source == source]
        taken = {r.slot for r in own}
        assert [r.k for r in sorted(own, key=lambda r: r.slot)] == list(range(own[0].n))
        done = 0
        for t in range(slots):
            done += t in taken
            assert abs(done - (t + 1) * own[0].n / slots) < 1


def test_order_and_exhausted_sources(spark):
    rows = [cases.row(i, "t", "en", "a") for i in range(40)]
    rows += [cases.row(100 + i, "t", "en", "b") for i in range(8)]
    got = [r.source for r in in_mixed_order(
        cases.frame(spark, rows), {"a": 0.5, "b": 0.5}).collect()]
    assert Counter(got) == {"a": 40, "b": 8}
    assert "b" in got[:32]  # blocks of 16 take turns from the start


@pytest.mark.parametrize("targets", [None, {"a": 0.6, "b": 0.3}])
def test_sorted_rows_are_in_the_order_of_slots(spark, targets):
    """Equal weights, a source without one, a null source, one that runs out."""
    rows = [cases.row(i, f"t{i}", "en", [None, "a", "b", "c", "d"][min(i % 7, 4)])
            for i in range(700)] + [cases.row(1000, "alone", "en", "e")]
    docs = cases.frame(spark, rows)
    slots = mixed(docs, targets, block=4, cycle=20).orderBy("slot", "place")
    assert [r.row_.doc_id for r in slots.collect()] == [
        r.doc_id for r in in_mixed_order(docs, targets, block=4, cycle=20).collect()]


def test_repeated_rows_without_id(spark):
    rows = [cases.row(None, "same", "en", None)] * 7
    assert in_mixed_order(cases.frame(spark, rows)).count() == 7


def test_empty_table(spark):
    docs = cases.frame(spark, [])
    assert in_mixed_order(docs).columns == docs.columns
    assert in_mixed_order(docs).count() == 0


@pytest.mark.parametrize("weights", [
    {"a": 0.9, "b": 0.0989, "c": 0.0011},
    {"hot": 0.13958, **{f"s{k:02}": 0.86042 / 19 for k in range(19)}}])
def test_deviation_from_the_target_does_not_add_up(spark, weights):
    rows = 8_000
    docs = spark.range(rows * len(weights)).selectExpr(
        "id AS doc_id", "'t' AS text",
        f"array({', '.join(repr(s) for s in weights)})[CAST(id div {rows} AS INT)] AS source")
    got = mixed(docs, weights, block=1, cycle=400).groupBy("slot").agg({"row_.source": "min"})
    order = [r[1] for r in sorted(got.collect())]
    share, total = Counter(), sum(weights.values())
    for t, source in enumerate(order, 1):
        share[source] += 1
        if share[source] == rows:
            break  # a source has run out
        assert all(abs(share[s] - t * w / total) < 2 for s, w in weights.items()), t
    assert t > 8_000


@pytest.mark.parametrize("others", [1, 2, 19, 100, 1_000])
def test_less_than_one_block_off_with_many_sources(spark, others):
    """One source of weight 0.5 beside equal ones, over several stretches."""
    weights = {"hot": 0.5, **{f"s{k:04}": 0.5 / others for k in range(others)}}
    blocks = {s: 2 + 6_000 // len(weights) for s in weights} | {"hot": 3_000}
    sizes = spark.createDataFrame(list(blocks.items()), "source string, size long")
    plan = sorted(block_slots(sizes, weights, 1, 100).select("slot", "source", "k").collect())
    assert [r.slot for r in plan] == list(range(sum(blocks.values())))
    done, hot = Counter(), weights["hot"]
    for t, r in enumerate(plan, 1):
        assert r.k == done[r.source]
        done[r.source] += 1
        if done["hot"] * 1.01 >= blocks["hot"]:
            break  # a source is about to run out
        assert abs(done["hot"] - t * hot) < 1
        assert abs(done[r.source] - t * weights[r.source]) < 1
        if t % 97 == 0:
            assert all(abs(done[s] - t * w) < 1 for s, w in weights.items())
    assert t > 2_000


def test_stretches_give_what_one_run_gives(spark):
    sizes = spark.createDataFrame([(None, 900), ("a", 37), ("b", 410), ("c", 1), ("d", 160)],
                                  "source string, size long")
    one, many = (sorted(block_slots(sizes, None, 1, cycle).select("slot", "source", "k").collect())
                 for cycle in (5_000, 60))
    assert one == many and len(one) == 1508


def test_ideal_goes_on_after_a_source_has_run_out(spark):
    sizes = spark.createDataFrame([("a", 20), ("b", 300), ("c", 300)], "source string, size long")
    plan = sorted(block_slots(sizes, {"a": 0.6, "b": 0.3, "c": 0.1}, 1, 50)
                  .select("slot", "source").collect())
    done = Counter()
    for t, r in enumerate(plan, 1):
        done[r.source] += 1
        if t * 0.6 > 20 and done["b"] < 299:
            rest = t - 20  # both keep their shares of what is left: 0.75 and 0.25
            assert abs(done["b"] - 0.75 * rest) < 1.01
