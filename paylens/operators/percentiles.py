"""Exact interpolated percentiles by radix selection.

Spark's exact ``percentile`` sends every distinct value to a single reducer. Here a value
becomes a whole number in the same order, its 64-bit image, and a wanted rank is found digit
by digit: counts by the leading digit tell which digit the rank falls into, only values with
that digit are counted by the next one, and so on. Counting is spread over all tasks and
combined before it is shuffled; what is ordered in one task is a digit's counts, whose number
is bounded, however the values lie. One scan of the column per digit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bits below each digit: a thousandth of a doubling, then 2^21 steps of that, twice.
_SHIFTS = (42, 21, 0)
_ONE = 1 << 52  # images of a doubling


def _with_image(values: DataFrame) -> DataFrame:
    """Adds ``m``, which rises with ``v`` for every double and is equal for equal ones.

    It is the number that the bits of the double make, sign apart: exponent, then fraction.
    Zeros are 0, NaN is above all, as in sorting.
    """
    sized = values.selectExpr("v", "abs(v) AS size").selectExpr(
        "v", "size", "CASE WHEN size > 0 AND size < double('inf')"
        " THEN greatest(least(floor(log2(size)), 1023), -1074) END AS e")
    # log2 may be one off next to a power of two; the leading part tells.
    sized = sized.selectExpr("v", "size", "e", "size / pow(2.0D, e) AS part")
    sized = sized.selectExpr(
        "v", "size", "e + CASE WHEN part >= 2 THEN 1 WHEN part < 1 THEN -1 ELSE 0 END AS e",
        "CASE WHEN part >= 2 THEN part / 2 WHEN part < 1 THEN part * 2 ELSE part END AS part")
    # Below 2^-1022 all doubles are the same step apart.
    small = "CAST(size / pow(2.0D, -1074) AS BIGINT)"
    normal = f"((e + 1023) * {_ONE}L + CAST((part - 1) * {_ONE}D AS BIGINT))"
    return sized.selectExpr("v", f"""CASE WHEN isnan(v) THEN {2047 * _ONE + 1}L
        WHEN size = 0 THEN 0L ELSE CASE WHEN v < 0 THEN -1L ELSE 1L END * CASE
        WHEN size = double('inf') THEN {2047 * _ONE}L
        WHEN e < -1022 THEN {small} ELSE {normal} END END AS m""")


def _digits(level: int) -> Column:
    """The image down to a digit."""
    return F.shiftright("m", _SHIFTS[level])


def _targets(placed: DataFrame, names: Sequence[str], wanted: dict[str, float]) -> DataFrame:
    """The leading digits that hold a wanted rank, with the ranks before them."""
    ranks = F.array(*[_rank(names, wanted, name, side) for name in names for side in (0, 1)])
    return placed.select(
        "digits", "first",
        F.explode(F.filter(
            ranks, lambda r: (r.rank >= F.col("first")) & (r.rank < F.col("next"))
        )).alias("r"),
    ).select("digits", "first", "r.*")


def _next(values: DataFrame, targets: DataFrame, level: int) -> DataFrame:
    """From targets at the digit before to targets at this one; ``v`` is a value there."""
    held = values.withColumn("before", _digits(level - 1)).withColumn("digits", _digits(level))
    # At most two per percentile, hence a broadcast of known size.
    touched = F.broadcast(targets.select(F.col("digits").alias("before")))
    counted = held.join(touched, "before", "left_semi").groupBy("before", "digits").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    within = Window.partitionBy("before").orderBy("digits").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    spans = counted.select(
        "before", "digits", "v", (F.sum("n").over(within) - F.col("n")).alias("from_"),
        F.sum("n").over(within).alias("to_"))
    known = F.broadcast(targets.withColumnRenamed("digits", "before"))
    offset = F.col("rank") - F.col("first")
    return spans.join(known, "before").where(
        (offset >= F.col("from_")) & (offset < F.col("to_"))
    ).select("digits", (F.col("first") + F.col("from_")).alias("first"), "which", "side", "rank",
             "part", "v")


def exact_percentiles(df: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """One row with a column per entry of ``wanted`` (name to fraction).

    NULLs are ignored; an empty input gives NULLs. The value at fraction p is
    interpolated between the ranks around p * (n - 1).
    """
    names = list(wanted)
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    values = _with_image(values)

    # Leading digits are bounded in number, so an ordered running total is cheap.
    counted = values.groupBy(_digits(0).alias("digits")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy("digits").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("digits").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    placed = counted.select(
        "digits",
        (F.sum("n").over(running) - F.col("n")).alias("first"),
        F.sum("n").over(running).alias("next"),
        (F.sum("n").over(whole) - 1).alias("last"),
    )
    found = _targets(placed, names, wanted)
    for level in range(1, len(_SHIFTS)):
        found = _next(values, found.drop("v"), level)
    picked = found.agg(*[
        F.max(F.when(
            (F.col("which") == i) & (F.col("side") == side), F.col(what)
        )).alias(f"{what}{i}_{side}")
        for i in range(len(names)) for side in (0, 1) for what in ("v", "part")
    ])
    return picked.select(*[
        (F.col(f"v{i}_0") + (F.col(f"v{i}_1") - F.col(f"v{i}_0")) * F.col(f"part{i}_0"))
        .alias(name)
        for i, name in enumerate(names)
    ])


def _rank(names: Sequence[str], wanted: dict[str, float], name: str, side: int) -> Column:
    position = F.col("last") * F.lit(float(wanted[name]))
    rank = F.floor(position) if side == 0 else F.ceil(position)
    return F.struct(
        F.lit(names.index(name)).alias("which"),
        F.lit(side).alias("side"),
        rank.cast("bigint").alias("rank"),
        (position - F.floor(position)).alias("part"),
    )
