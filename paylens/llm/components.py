"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))
    ).first())


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Alternates two steps until nothing changes: every larger neighbour of a node
    is tied to the node's smallest neighbour, then every smaller one is. Minima
    are combined before they are shuffled and hub nodes meet their minimum in a
    plain join, which adaptive execution splits. Null or equal ends are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")) \
        .where("a <> b").distinct()
    edges = scratch.save(edges, f"{label}-0")
    state, step = _state(edges), 0
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")) \
            .select("u", F.least("u", "m").alias("m"))
        raised = both.where("v > u").join(lowest, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = raised.groupBy("u").agg(F.min("v").alias("m"))
        tied = raised.join(below, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        step += 1
        edges = scratch.save(
            tied.union(below.select("u", F.col("m").alias("v"))).distinct(), f"{label}-{step}")
        scratch.drop(f"{label}-{step - 1}")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        roots.select("node", F.col("node").alias("root")))
