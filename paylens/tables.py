"""Column-pruned access to the seven tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .model import TABLES
from .sources import files, manifest
from .sources.store import read_bucketed, read_stored
from .sources.zones import Span, moment


class Tables:
    """What a query reads. ``scan`` returns just the asked-for columns.

    Subclasses may use the column list to leave out whole lookups, not only
    columns, when a table is derived from others.
    """

    def __init__(self, frames: Mapping[str, DataFrame]):
        unknown = set(frames) - set(TABLES)
        if unknown:
            raise KeyError(f"not a known table: {sorted(unknown)}")
        self._frames = dict(frames)

    @classmethod
    def stored(cls, spark: SparkSession, folder: str) -> StoredTables:
        """Tables written by ``sources.store``, as they are now; or plain Parquet folders."""
        return StoredTables(spark, folder)

    def columns(self, name: str) -> list[str]:
        present = self._frames[name].columns
        return [c for c in TABLES[name].names if c in present]

    def scan(self, name: str, *columns: str) -> DataFrame:
        return self._frames[name].select(*(columns or self.columns(name)))

    def by_key(self, name: str, column: str, *columns: str) -> DataFrame:
        """What ``scan`` gives, already divided by ``column`` if the source keeps it so."""
        return self.scan(name, *columns)

    def within(
        self, name: str, column: str, since: str | None = None, until: str | None = None,
    ) -> Tables:
        """The tables for a reader that wants only rows of ``name`` in a stretch of ``column``.

        ``since`` and ``until`` are SQL moments. Rows outside may still be there: this only
        allows a source to leave them out.
        """
        return self

    def register(self) -> None:
        """Make the tables available to ``spark.sql`` under their own names."""
        for name in TABLES:
            self.scan(name).createOrReplaceTempView(name)


class StoredTables(Tables):
    """One version of every stored table: later loads do not show."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._versions: dict[str, manifest.Version | None] = {}
        self._read: dict[str, DataFrame] = {}

    def _frame(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self._open(name, None)
        return self._read[name]

    def _open(self, name: str, span: Span | None) -> DataFrame:
        path, schema = f"{self._folder}/{name}", TABLES[name].schema
        if name not in self._versions:
            kept = files.exists(self._spark, f"{path}/versions")
            self._versions[name] = manifest.current(self._spark, path) if kept else None
        version = self._versions[name]
        if version is None:
            return self._spark.read.schema(schema).parquet(path)
        found = read_stored(self._spark, name, path, span, version)
        return found if found is not None else self._spark.createDataFrame([], schema)

    def columns(self, name: str) -> list[str]:
        return TABLES[name].names

    def loads(self, name: str) -> list[str]:
        """The folders of the loads that make up a table."""
        self._frame(name)
        version = self._versions[name]
        return [b.folder for b in version.batches if b.rows] if version else []

    def by_key(self, name: str, column: str, *columns: str) -> DataFrame:
        rows = self._frame(name)
        version = self._versions[name]
        if TABLES[name].bucket_by == column and version is not None and version.rows:
            rows = read_bucketed(self._spark, name, f"{self._folder}/{name}", version)
        return rows.select(*(columns or self.columns(name)))

    def scan(self, name: str, *columns: str) -> DataFrame:
        return self._frame(name).select(*(columns or self.columns(name)))

    def within(
        self, name: str, column: str, since: str | None = None, until: str | None = None,
    ) -> StoredTables:
        """Opens only the files of ``name`` that overlap, if it is stored in this order."""
        if TABLES[name].order != column:
            return self
        made = StoredTables(self._spark, self._folder)
        self._frame(name)  # so that both show the same version
        made._versions, made._read = self._versions, dict(self._read)
        if self._versions[name] is not None:
            made._read[name] = self._open(name, Span(self._moment(since), self._moment(until)))
        return made

    def _moment(self, sql: str | None):
        return moment(self._spark.sql(f"SELECT CAST({sql} AS STRING)").first()[0]) if sql else None
