"""Decides whether a side of a join is small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Parquet files grow when decoded; the file size is scaled by this factor.
_DECODED = 3
# A side many times the threshold still costs less to send than moving a wide table; more
# than this many times it would not fit beside the tasks.
WIDE = 8


def _limit_bytes(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760b")
    text = text.strip().lower()
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = text.removesuffix("b")
    if text and text[-1] in scale:
        return int(text[:-1]) * scale[text[-1]]
    return int(text)


def fits_broadcast(df: DataFrame, times: int = 1) -> bool:
    """True if everything ``df`` is read from is below ``times`` the broadcast threshold.

    Uses the sizes Spark itself knows for the scanned relations, so no job runs.
    ``df`` must not produce more rows than it reads (a filter, a projection, a
    lookup of a parent row). Without plan statistics the answer is no, and the
    caller takes its shuffling path.
    """
    limit = _limit_bytes(df)
    if limit <= 0:
        return False
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
        total = 0
        while leaves.hasNext():
            total += int(leaves.next().stats().sizeInBytes())
    except AttributeError:
        return False
    return total * _DECODED <= limit * times
