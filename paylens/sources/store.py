"""Stored tables: fresh and incremental loads with verified counts (E12-E18).

A table is a folder with ``versions`` (see ``manifest``), ``data``, ``zones`` and ``keys``,
each of the last three with a folder per load. Keys are compared at each load without
shuffling what is stored: they lie in buckets, as part of the data where a table is
bucketed by its key, and else, the key alone, beside it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import TABLES, Table
from ..operators.sizing import fits_broadcast
from ..session import released_shuffles, shared_folder
from . import bucketed, files, manifest, zones
from .manifest import Batch, ConcurrentLoad, Version
from .zones import Span

BATCH, STAMP = "batch_id", "uploaded_at"
_LARGE, _SLICES = 100, 4  # broadcast thresholds that make a batch large; what it is divided into
__all__ = ["BATCH", "STAMP", "ConcurrentLoad", "CountMismatch", "LoadResult", "Prepared", "Span",
           "clean_up", "commit", "load", "load_report", "new_rows", "prepare", "quality_report",
           "read_bucketed", "read_loads", "read_stored", "stored_batches"]


class CountMismatch(RuntimeError):
    """The files of a load do not hold the rows that were written."""


@dataclass(frozen=True)
class LoadResult:
    table_name: str
    action: str  # fresh, appended or unchanged
    rows_before: int
    rows_incoming: int
    rows_inserted: int
    rows_skipped: int
    rows_after: int
    nulls: dict[str, int] = field(default_factory=dict)  # of the incoming rows, by column
    lost: dict[str, int] = field(default_factory=dict)  # unreadable values that became NULL

    def row(self) -> tuple:
        return (self.table_name, self.action, self.rows_before, self.rows_incoming,
                self.rows_inserted, self.rows_skipped, self.rows_after)


@dataclass(frozen=True)
class Prepared:
    """A load whose files are written and counted, and which no reader sees yet."""

    path: str
    base: Version
    batches: tuple[Batch, ...]
    buckets: int
    folder: str
    result: LoadResult


def new_rows(
    incoming: DataFrame, stored_keys: DataFrame, key: str, null_stored: bool | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Incoming rows whose key is not stored yet; a NULL key equals a NULL key.

    The stored keys, the large side, are first cut to those of the batch by a semi join,
    and only what is left meets the incoming rows. A small batch is broadcast there. Keys
    that are read from ``buckets`` stay where they are and the batch's keys go to them.
    ``null_stored`` says whether a NULL key is stored; left open, the stored keys tell.
    """
    batch = incoming.select(F.col(key).alias("batch_key")).distinct()
    if fits_broadcast(batch):
        batch = F.broadcast(batch)
    elif buckets:  # else Spark shuffles both sides if there are fewer than its partitions
        batch = batch.repartition(buckets, "batch_key")
    stored = stored_keys.select(F.col(key).alias("stored_key"))
    present = stored.join(
        batch, F.col("stored_key") == F.col("batch_key"), "left_semi").distinct()
    fresh = incoming.join(present, F.col(key) == F.col("stored_key"), "left_anti")
    if null_stored is not None:
        return fresh.where(F.col(key).isNotNull()) if null_stored else fresh
    # One row if a NULL is stored; only incoming NULLs have the marker it is compared with.
    a_null = stored.where("stored_key IS NULL").limit(1).select(F.lit(1).alias("marker"))
    is_null = F.when(F.col(key).isNull(), F.lit(1))
    return fresh.join(F.broadcast(a_null), is_null == F.col("marker"), "left_anti")


def _schema(name: str) -> T.StructType:
    """A stored table's columns. The batch is text, whatever its names look like."""
    fields = [*TABLES[name].schema, T.StructField(STAMP, T.TimestampNTZType()),
              T.StructField(BATCH, T.StringType())]
    return T.StructType(fields)


def stored_batches(spark: SparkSession, path: str) -> tuple[Batch, ...]:
    """The batches that make up a stored table now."""
    return manifest.current(spark, path.rstrip("/")).batches


def read_stored(
    spark: SparkSession, name: str, path: str, span: Span | None = None,
    version: Version | None = None,
) -> DataFrame | None:
    """A stored table with its load columns; None if it holds no batch.

    With a ``span`` of the table's order column, files that hold nothing of it are left
    out; rows outside may remain, so the caller filters as well. ``version``: the newest,
    unless given.
    """
    path = path.rstrip("/")
    version = version or manifest.current(spark, path)
    held = [b for b in version.batches if b.rows]
    if not held:
        return None
    places = [b.folder for b in held]
    if span and TABLES[name].order:
        places = [b.folder for b in held if zones.overlaps(b, span)]
        if places:
            places = zones.files_within(spark, f"{path}/zones", places, span)
        if not places:
            return spark.createDataFrame([], _schema(name))
    return _files(spark, name, *[f"{path}/data/{p}" for p in places])


def read_loads(spark: SparkSession, name: str, path: str, loads: Iterable[str]) -> DataFrame:
    """The rows of some loads of a stored table, by the folders of their batches."""
    return _files(spark, name, *[f"{path.rstrip('/')}/data/{load}" for load in loads])


def read_bucketed(spark: SparkSession, name: str, path: str, version: Version) -> DataFrame:
    """A stored table that Spark takes as divided by its ``bucket_by`` column."""
    return bucketed.read(
        spark, _schema(name), TABLES[name].bucket_by, f"{path.rstrip('/')}/data",
        [b.folder for b in version.batches if b.rows], version.buckets)


def load(
    spark: SparkSession, df: DataFrame, name: str, folder: str, batch: str,
    dedupe_batch: bool = False, buckets: int | None = None,
) -> LoadResult:
    """Write the rows of ``df`` that are new to the table; see ``prepare`` and ``commit``."""
    return commit(spark, prepare(spark, df, name, folder, batch, dedupe_batch, buckets))


def prepare(
    spark: SparkSession, df: DataFrame, name: str, folder: str, batch: str,
    dedupe_batch: bool = False, buckets: int | None = None,
) -> Prepared:
    """Write the rows of ``df`` that are new to the table, and count them.

    The rows of one batch are replaced as a whole: what is new is compared with all other
    batches. A run can be repeated with more, fewer or no rows. Rows are only ever added:
    a stored row with the same key stays as it is. Repeated keys inside a batch are kept
    unless ``dedupe_batch``. ``buckets`` divides the keys of a new table for good (default:
    as many as shuffles have partitions); a bucket of them should fit into one task. Until
    ``commit`` the table is as it was, and a failure leaves nothing behind.
    """
    table, path = TABLES[name], f"{folder.rstrip('/')}/{name}"
    if files.exists(spark, path) and any(
            child.startswith(f"{BATCH}=") for child in files.children(spark, path)):
        raise ValueError(f"{path} was written without versions; load its rows into a new folder")
    base = manifest.current(spark, path)
    others = [b for b in base.batches if b.name != batch]
    buckets = base.buckets or buckets or bucketed.default_buckets(spark)
    run = f"load-{uuid.uuid4().hex}"
    if dedupe_batch:
        df = df.dropDuplicates([table.key])
    before = sum(b.rows for b in others)
    try:
        with released_shuffles(spark):
            slices = _slices(df, table, buckets)
            if before or len(slices) > 1:
                with _staged(spark, df, name) as staged:
                    incoming, nulls = _nulls(staged)
                    parts = [staged.where(s) for s in slices]
                    if before:
                        keys = _stored_keys(spark, table, path, others, buckets)
                        a_null = any(b.null_keys for b in others)
                        parts = [new_rows(part, keys.where(s), table.key, a_null, buckets)
                                 for part, s in zip(parts, slices)]
                    made = _write(spark, parts, table, path, run, batch, buckets)
            else:
                made, incoming = _write(spark, [df], table, path, run, batch, buckets), None
                nulls = {}
                if made.rows:
                    nulls = _nulls(_files(spark, name, f"{path}/data/{run}").select(
                        *df.columns))[1]
    except BaseException:
        _remove(spark, path, run)
        raise
    incoming = made.rows if incoming is None else incoming
    action = "fresh" if not others else "appended" if made.rows else "unchanged"
    result = LoadResult(name, action, before, incoming, made.rows, incoming - made.rows,
                        before + made.rows, nulls)
    batches = (*others, made) if made.rows else tuple(others)
    return Prepared(path, base, batches, buckets, run, result)


def commit(spark: SparkSession, prepared: Prepared) -> LoadResult:
    """Make a prepared load visible; ConcurrentLoad if the table has changed since."""
    try:
        if prepared.batches != prepared.base.batches:
            manifest.commit(
                spark, prepared.path, prepared.base, prepared.batches, prepared.buckets)
    except ConcurrentLoad:
        _remove(spark, prepared.path, prepared.folder)
        raise
    return prepared.result


def discard(spark: SparkSession, prepared: Prepared) -> None:
    """Remove the files of a load that is not to be committed."""
    _remove(spark, prepared.path, prepared.folder)


def _remove(spark: SparkSession, path: str, run: str) -> None:
    for part in ("data", "zones", "keys"):
        files.remove(spark, f"{path}/{part}/{run}")


def _slices(df: DataFrame, table: Table, buckets: int) -> list[Column]:
    """Tests that divide a large batch by the buckets of its keys; else one that all rows pass.

    What a slice shuffles is deleted before the next. Only tables in buckets of their key are
    divided: no bucket is in two slices, so a load has no more files for it, and stored keys
    are divided by the same test.
    """
    if table.bucket_by != table.key or fits_broadcast(df, _LARGE):
        return [F.lit(True)]
    n = min(_SLICES, buckets)
    bucket = F.pmod(F.hash(F.col(table.key).cast(table.schema[table.key].dataType)), F.lit(buckets))
    return [F.pmod(bucket, F.lit(n)) == k for k in range(n)]


@contextmanager
def _staged(spark: SparkSession, df: DataFrame, name: str) -> Iterator[DataFrame]:
    """The batch as a table of its own: it is read several times, but parsed only once."""
    place = f"{shared_folder(spark)}/staging/{uuid.uuid4().hex}"
    try:
        df.write.option("compression", bucketed.CODEC).parquet(f"{place}/{name}")
        yield spark.read.schema(df.schema).parquet(f"{place}/{name}")
    finally:
        files.remove(spark, place)


def _nulls(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and NULLs by column, from one scan."""
    counted = df.agg(F.count(F.lit(1)).alias("rows_"),
                     *[F.count(F.col(f"`{c}`")).alias(f"n_{c}") for c in df.columns]).first()
    return counted.rows_, {c: counted.rows_ - counted[f"n_{c}"] for c in df.columns}


def _stored_keys(
    spark: SparkSession, table: Table, path: str, batches: list[Batch], buckets: int,
) -> DataFrame:
    """The keys of the given batches, read from their buckets."""
    part = "data" if table.bucket_by == table.key else "keys"
    return bucketed.read(spark, T.StructType([table.schema[table.key]]), table.key,
                         f"{path}/{part}", [b.folder for b in batches if b.rows], buckets)


def _write(
    spark: SparkSession, parts: list[DataFrame], table: Table, path: str, run: str, batch: str,
    buckets: int,
) -> Batch:
    """Writes rows, zones and keys of a load; the batch with the rows that are really there."""
    total = 0
    stamp = F.current_timestamp()
    if len(parts) > 1:  # the same for all
        stamp = F.timestamp_micros(F.lit(
            spark.range(1).select(F.unix_micros(stamp)).first()[0]))
    for fresh in parts:
        written = Observation(f"load {table.name}")
        rows = fresh.withColumn(STAMP, stamp.cast("timestamp_ntz"))
        rows = rows.withColumn(BATCH, F.lit(batch)).select(*_schema(table.name).names)
        if table.bucket_by:
            bucketed.write(
                rows, table.bucket_by, f"{path}/data", run, buckets, table.order, written)
        else:
            if table.order:  # each file a short stretch; the key splits a moment with many rows
                rows = rows.repartitionByRange(table.order, table.key)
                rows = rows.sortWithinPartitions(table.order)
            rows = rows.observe(written, F.count(F.lit(1)).alias("n"))
            rows.write.option("compression", bucketed.CODEC).parquet(f"{path}/data/{run}")
        total += written.get["n"]
    found = _count(spark, table.name, f"{path}/data/{run}")
    if found != total:
        raise CountMismatch(f"{table.name}: {total} rows written, {found} found")
    made = Batch(batch, run, found)
    if not found:
        _remove(spark, path, run)
        return made
    stored = _files(spark, table.name, f"{path}/data/{run}")
    if table.order:
        zones.write(stored, table.order, f"{path}/zones", run)
    if table.bucket_by != table.key:
        keys = stored.select(table.key).where(F.col(table.key).isNotNull())
        bucketed.write(keys, table.key, f"{path}/keys", run, buckets)
    order = table.order or table.key
    low, high, keyed = stored.agg(F.min(order), F.max(order), F.count(table.key)).first()
    if table.order:
        made = replace(made, low=zones.text(low), high=zones.text(high))
    return replace(made, null_keys=found - keyed)


def _files(spark: SparkSession, name: str, *places: str) -> DataFrame:
    """The rows of files and folders; months are folders, not columns."""
    found = spark.read.schema(_schema(name)).option("recursiveFileLookup", "true")
    return found.parquet(*places)


def _count(spark: SparkSession, name: str, place: str) -> int:
    """Rows in the files of a load, from their footers."""
    return _files(spark, name, place).count()


def clean_up(spark: SparkSession, folder: str, name: str, older_than_hours: float = 24.0) -> int:
    """Removes the files of loads that the table does not name any more; how many loads.

    Young ones stay: a load may be about to commit them, or a reader still open them. Older
    versions of the table can then no longer be read, so their files go as well.
    """
    path = f"{folder.rstrip('/')}/{name}"
    version = manifest.current(spark, path)
    live = {b.folder for b in version.batches}
    gone: set[str] = set()
    for part in ("data", "zones", "keys"):
        if files.exists(spark, f"{path}/{part}"):
            for child, place in files.children(spark, f"{path}/{part}").items():
                if child not in live and files.age_hours(spark, place) >= older_than_hours:
                    files.remove(spark, place)
                    gone.add(child)
    for number in manifest.numbers(spark, path):
        place = f"{path}/versions/{number:012d}.json"
        if number < version.number and files.age_hours(spark, place) >= older_than_hours:
            files.remove(spark, place)
    return len(gone)


def load_report(spark: SparkSession, results: list[LoadResult]) -> DataFrame:
    """The outcome of a run, a row per table."""
    return spark.createDataFrame(
        [r.row() for r in results],
        "table_name string, action string, rows_before long, rows_incoming long,"
        " rows_inserted long, rows_skipped long, rows_after long",
    )


def quality_report(spark: SparkSession, results: list[LoadResult]) -> DataFrame:
    """NULL cells and lost values of the incoming rows, a row per table and column."""
    return spark.createDataFrame(
        [(r.table_name, column, r.rows_incoming, n, r.lost.get(column, 0))
         for r in results for column, n in r.nulls.items()],
        "table_name string, column_name string, rows_incoming long, null_cells long,"
        " lost_values long",
    )
