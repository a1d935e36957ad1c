"""Smallest and largest value of a table's order column, per file.

A load sorts a table that has an order column (a moment or a date) by ranges, so that each
file covers a short stretch. The zones of a load are a small table beside its files; a
reader that wants a stretch of time opens only the files that overlap it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifest import Batch


@dataclass(frozen=True)
class Span:
    """A stretch of an order column, both ends included; None is open."""

    since: datetime | None = None
    until: datetime | None = None


def moment(value) -> datetime | None:
    """A date, a moment or its ISO text as a moment."""
    if value is None or isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime.combine(value, time())
    return datetime.fromisoformat(str(value))


def text(value) -> str | None:
    """The ISO text of a date or moment, as manifests hold it."""
    return None if value is None else value.isoformat()


def write(rows: DataFrame, order: str, path: str, load: str) -> None:
    """Writes the zones of the files of a load, which ``rows`` is read from."""
    file = F.substring_index(F.col("_metadata.file_path"), f"/{load}/", -1)
    rows.select(order, file.alias("file")).groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.min(order).alias("low"), F.max(order).alias("high"),
    ).coalesce(1).write.parquet(f"{path}/{load}")


def overlaps(batch: Batch, span: Span) -> bool:
    """Whether a batch may hold rows of the span; rows without a value are in none."""
    low, high = moment(batch.low), moment(batch.high)
    if low is None or high is None:
        return False
    return (span.since is None or high >= span.since) and (
        span.until is None or low <= span.until)


def _literal(value: datetime) -> Column:
    """As it stands, whatever the time zones of the session and of this machine."""
    return F.expr(f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'")


def files_within(spark: SparkSession, path: str, folders: list[str], span: Span) -> list[str]:
    """Of the given loads, 'folder/file' of every file that overlaps the span."""
    zones = spark.read.parquet(*[f"{path}/{f}" for f in folders]).withColumn(
        "folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    if span.since is not None:
        zones = zones.where(F.col("high") >= _literal(span.since))
    if span.until is not None:
        zones = zones.where(F.col("low") <= _literal(span.until))
    # One line per file to be opened.
    return sorted(f"{r.folder}/{r.file}" for r in zones.select("folder", "file").collect())
