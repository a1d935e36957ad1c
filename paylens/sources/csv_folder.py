"""Reads a folder of CSV files, one table per file or per directory of parts (E1, E2)."""

from __future__ import annotations

import csv
import warnings
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..model import TABLES
from . import files, quoted_csv

_FREE_TEXT = {table.raw_name for table in TABLES.values() if table.free_text}


def read_folder(
    spark: SparkSession, folder: str, plain: Iterable[str] = (),
) -> dict[str, DataFrame]:
    """File stem to table, every column as text; nothing is inferred.

    Text only gets its type when it is cleaned, so no pass over the data is spent on
    guessing. All files are split. Those with free text may hold quoted line breaks (see
    ``quoted_csv``); ``plain`` names file stems with free text but without such breaks,
    which saves a pass; a break that is there all the same stops the load. A directory of
    parts is one table: each part is read by its own header, in whatever order, and parts
    with other columns stop the load.
    """
    if not files.exists(spark, folder):
        raise FileNotFoundError(f"no such folder: {folder}")
    found = {
        name.removesuffix(".csv"): path
        for name, path in sorted(files.children(spark, folder).items())
        if name.endswith(".csv")
    }
    if not found:
        warnings.warn(f"no CSV file in {folder}", stacklevel=2)
    return {stem: _read(spark, stem, path, frozenset(plain)) for stem, path in found.items()}


def _headers(spark: SparkSession, stem: str, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files by their columns in order; files without anything are left out."""
    parts = [path]
    if files.is_folder(spark, path):
        parts = [p for name, p in sorted(files.children(spark, path).items())
                 if not name.startswith(("_", "."))]
    found: dict[tuple[str, ...], list[str]] = {}
    for part in parts:
        line = files.first_line(spark, part)
        if line:
            found.setdefault(tuple(next(csv.reader([line]))), []).append(part)
    if not found:
        raise ValueError(f"no header in {path}")
    if len({frozenset(columns) for columns in found}) > 1:
        raise ValueError(f"{stem}: the header of one part has other columns than another's")
    return found


def _read(spark: SparkSession, stem: str, path: str, plain: frozenset[str]) -> DataFrame:
    def rows(columns: tuple[str, ...], parts: list[str]) -> DataFrame:
        if stem in _FREE_TEXT and stem not in plain:
            return quoted_csv.read(spark, parts, list(columns))
        return (
            spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"')
            .option("enforceSchema", False).csv(parts)
        )

    return reduce(DataFrame.unionByName, [
        rows(columns, parts) for columns, parts in _headers(spark, stem, path).items()])


def as_tables(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The seven tables under their own names."""
    missing = [t.raw_name for t in TABLES.values() if t.raw_name not in raw]
    if missing:
        raise KeyError(f"missing input: {missing}")
    return {name: raw[table.raw_name] for name, table in TABLES.items()}
