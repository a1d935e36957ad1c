"""Mixing of sources to target weights by Pfair windows.

Each source is cut into blocks of equally many documents. In the ideal mixture every
source advances by its exact weight, and the others in proportion once one has run out.
A block is released in the slot in which the ideal begins it, and its deadline is the
slot in which the ideal ends it. Every slot takes, of the released blocks, the one with
the earliest deadline. That meets all deadlines, so at any slot every source is less than
one block off the ideal, however many sources there are. ``cycle_plan`` gives one cycle
of whole shares in the same way. DataFrame and SQL functions only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET_ROWS = 5_000

# One step of the cycle: of the released blocks take the one with the earliest deadline.
_STEP = """
transform(
  array(array_min(filter(
    transform(shares, (x, i) -> struct(
      ((acc.done[i] + 1) * slots + x.n - 1) div x.n AS deadline, i AS i,
      acc.done[i] * slots div x.n <= t AND acc.done[i] < x.n AS open)),
    y -> y.open)).i),
  p -> struct(
    transform(acc.done, (v, i) -> IF(i = p, v + 1, v)) AS done,
    array_append(acc.plan, struct(p AS i, acc.done[p] AS k, t AS slot)) AS plan)
)[0]
"""
_FOLD = f"""
aggregate(sequence(0L, slots - 1),
  struct(transform(shares, x -> 0L) AS done,
         CAST(array() AS ARRAY<STRUCT<i: INT, k: BIGINT, slot: BIGINT>>) AS plan),
  (acc, t) -> {_STEP}, acc -> acc.plan)
"""


def _weight(targets: Mapping[str, float] | None) -> Column:
    if targets is None:
        return F.sqrt(F.col("size").cast("double"))
    known = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair]) \
        if targets else F.expr("map('', 0.0D)")
    weight = F.try_element_at(known, F.coalesce("source", F.lit(""))).cast("double")
    return F.coalesce(weight, F.lit(0.0))


def _weighed(sizes: DataFrame, targets: Mapping[str, float] | None, block: int,
             cycle: int) -> DataFrame:
    """(source, blocks, w) per source: exact weights, of which only the proportions count.

    A source without a weight gets that of one block per cycle.
    """
    weighed = sizes.where("size > 0").select(
        "source", F.expr(f"(size + {block - 1}) div {block}").alias("blocks"),
        F.greatest(_weight(targets), F.lit(0.0)).alias("w"))
    totals = weighed.agg(F.sum("w").alias("sum_w"))
    return weighed.crossJoin(F.broadcast(totals)).select("source", "blocks", F.expr(
        f"CASE WHEN sum_w <= 0 THEN 1D WHEN w > 0 THEN w / sum_w ELSE 1D / {cycle} END").alias("w"))


def _slots_before(x: str) -> str:
    """SQL for the slots that all sources take up to ``x``, each until it runs out."""
    return f"aggregate(shares, 0D, (a, s) -> a + least(CAST(s.blocks AS DOUBLE), s.w * {x}))"


# One slot: of the released blocks take the one with the earliest deadline.
_SLOT = """
transform(
  array(array_min(filter(
    transform(lanes, (x, i) -> struct(
      get(x.jobs, acc.done[i]).r > t AS early, get(x.jobs, acc.done[i]).d AS d, i AS i)),
    y -> y.d IS NOT NULL)).i),
  p -> struct(
    transform(acc.done, (v, i) -> IF(i = p, v + 1, v)) AS done,
    IF(t < low, acc.plan, array_append(acc.plan, struct(
      lanes[p].source AS source, lanes[p].jobs[acc.done[p]].k AS k, t AS slot))) AS plan)
)[0]
"""
_STRETCH = f"""
aggregate(sequence(start, high - 1),
  struct(transform(lanes, x -> 0) AS done,
         CAST(array() AS ARRAY<STRUCT<source: STRING, k: BIGINT, slot: BIGINT>>) AS plan),
  (acc, t) -> {_SLOT}, acc -> acc.plan)
"""


def block_slots(sizes: DataFrame, targets: Mapping[str, float] | None, block: int,
                cycle: int) -> DataFrame:
    """(source, k, slot) of every block; slots are 0, 1, ... without gaps.

    sizes: one row (source, size) per source. Earliest deadline first runs over stretches
    of slots side by side, each from one stretch before its own. Whatever blocks are taken
    as done there, after the longest window all that were open are done, so the rest is
    the same as in one run over all slots. A stretch is as long as the longest window.
    """
    weighed = _weighed(sizes, targets, block, cycle)
    whole = weighed.agg(F.collect_list(F.struct("blocks", "w")).alias("shares"))
    # The first window of a source is its longest, as less and less sources share the slots.
    longest, slots = weighed.crossJoin(F.broadcast(whole)).agg(
        F.max(F.expr(_slots_before("(1 / w)"))), F.sum("blocks")).first()
    slots = slots or 0
    size = max(cycle, math.ceil(longest or 0) + 2)

    # In two steps, so that no row holds all numbers of a large source.
    every = weighed.select("source", "w", "blocks", F.explode(F.expr(
        f"sequence(0L, blocks - 1, {_BUCKET_ROWS}L)")).alias("low"))
    every = every.select("source", "w", F.explode(F.expr(
        f"sequence(low, least(low + {_BUCKET_ROWS}, blocks) - 1)")).alias("k"))
    every = every.crossJoin(F.broadcast(whole)).select(
        "source", "k", F.expr(_slots_before("(k / w)")).alias("a"),
        F.expr(_slots_before("((k + 1) / w)")).alias("b"))
    # A border that is a whole number but for the rounding of doubles is that number.
    every = every.select("source", "k", F.expr("floor(a + 1e-9D + 1e-12D * a)").alias("r"),
                         F.expr("ceil(b - 1e-9D - 1e-12D * b)").alias("d"))
    every = every.withColumn("d", F.expr("greatest(d, r + 1)"))

    # Stretch m has the slots from m * size on and starts one stretch earlier.
    due = every.groupBy(F.expr(f"(d + {size - 1}) div {size}").alias("m")).agg(
        F.count(F.lit(1)).alias("n"))
    last = max(slots - 1, 0) // size
    counts = due.union(every.sparkSession.range(last + 1).select("id", F.lit(0).cast("long")))
    counts = counts.groupBy("m").agg(F.sum("n").alias("n")).select("m", F.sum("n").over(
        Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)).alias("due"))
    stretches = counts.select(
        (F.col("m") + 1).alias("m"), (F.col("m") * size - F.col("due")).alias("ahead"))
    near = every.withColumn("m", F.explode(F.expr(
        f"sequence(least(r div {size}, {last}L), least((d - 1) div {size} + 1, {last}L))")))
    near = near.join(stretches, "m", "left").withColumn(
        "start", F.expr(f"greatest(m - 1, 0L) * {size}"))
    order = Window.partitionBy("m").orderBy(
        F.expr("r >= start"), "d", F.col("source").asc_nulls_first(), "k")
    left = near.withColumn("nth", F.row_number().over(order)).where(
        "start = 0 OR nth > ahead")
    lanes = left.groupBy("m", "start", "source").agg(
        F.sort_array(F.collect_list(F.struct("k", "r", "d"))).alias("jobs"))
    lanes = lanes.groupBy("m", "start").agg(
        F.sort_array(F.collect_list(F.struct("source", "jobs"))).alias("lanes"))
    lanes = lanes.withColumn("low", F.expr(f"m * {size}")).withColumn(
        "high", F.expr(f"least((m + 1) * {size}, {slots}L)"))
    return lanes.select(F.explode(F.expr(_STRETCH)).alias("p")).select("p.*")


def cycle_plan(sizes: DataFrame, targets: Mapping[str, float] | None, cycle: int) -> DataFrame:
    """(source, n, k, slots, slot): the slot of each source's block k within one cycle.

    sizes: one row (source, size) per source. Without ``targets`` a source's weight
    is the square root of its size; with them, a source not named gets one block per
    cycle. All sources are held in one row, so the work is sources times slots.
    """
    whole = sizes.select("source", _weight(targets).alias("w")).agg(
        F.sort_array(F.collect_list(F.struct("source", "w"))).alias("held"))
    whole = whole.withColumn("total", F.expr("aggregate(held, 0.0D, (a, x) -> a + x.w)"))
    share = f"CAST(greatest(1, round({cycle} * x.w / nullif(total, 0.0D))) AS BIGINT)"
    whole = whole.select(F.expr(
        f"transform(held, x -> struct(x.source AS source, coalesce({share}, 1L) AS n))"
    ).alias("shares"))
    whole = whole.withColumn("slots", F.expr("aggregate(shares, 0L, (a, x) -> a + x.n)"))
    whole = whole.where("slots > 0").select("shares", "slots", F.explode(F.expr(_FOLD)).alias("p"))
    return whole.select(F.expr("shares[p.i].source").alias("source"),
                        F.expr("shares[p.i].n").alias("n"), "p.k", "slots", "p.slot")


def mixed(docs: DataFrame, targets: Mapping[str, float] | None = None, block: int = 16,
          cycle: int = 400) -> DataFrame:
    """``row_`` (all columns), ``block``, ``slot`` and ``place``; every row of ``docs``.

    Rows in the order of (slot, place) are the mixture: ``slot`` numbers the blocks
    of all sources, ``block`` those of one source, ``place`` the rows of a block.
    Within a source rows are in the order of a hash of doc_id. Numbering goes by
    hash buckets of bounded size, so a source of any size is spread over tasks.

    Nothing is dropped or repeated. A null source is a source of its own, null and
    repeated ids and texts are ordinary rows, an empty table gives an empty result.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"))
    rows = rows.select("row_", F.col("row_.source").cast("string").alias("source"),
                       F.xxhash64("row_.doc_id").alias("h"))
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(
        F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rows = rows.withColumn("bucket", F.expr(f"pmod(h, {total // _BUCKET_ROWS + 1}L)"))

    counts = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("held").over(before), F.lit(0)))
    # The slots come with the counts, so that texts are not shuffled for them.
    slots = block_slots(sizes, targets, block, cycle).withColumnRenamed("source", "s")
    own = counts.withColumn("k", F.explode(F.expr(
        f"sequence(first div {block}, (first + held - 1) div {block})")))
    own = own.alias("o").join(slots.alias("t"), F.col("source").eqNullSafe(F.col("s"))
                              & (F.col("o.k") == F.col("t.k")))
    own = own.groupBy("source", "bucket", "first").agg(
        F.sort_array(F.collect_list(F.struct("o.k", "slot"))).alias("slots"))
    counts = own.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "first", "slots")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "row_.doc_id", "tie")
    ranked = rows.withColumn("tie", F.xxhash64("row_.text")).withColumn(
        "rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(counts, ranked.source.eqNullSafe(counts.s)
                         & (ranked.bucket == counts.b)).withColumn(
        "rank", F.col("first") + F.col("rank"))
    return ranked.select(
        "row_", F.expr(f"rank div {block}").alias("block"),
        F.expr(f"slots[CAST(rank div {block} - first div {block} AS INT)].slot").alias("slot"),
        F.expr(f"rank % {block}").alias("place"))


def in_mixed_order(docs: DataFrame, targets: Mapping[str, float] | None = None, block: int = 16,
                   cycle: int = 400) -> DataFrame:
    """The rows of ``docs`` sorted into the mixture."""
    return mixed(docs, targets, block, cycle).orderBy("slot", "place").select("row_.*")
