"""The whole run: read the folder, clean seven tables, load seven tables (E19)."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..model import TABLES
from ..tables import Tables
from .cleaning import Formats, clean, unread
from .csv_folder import as_tables, read_folder
from .store import LoadResult, Prepared, commit, discard, prepare, read_stored

# The published order of the uploads.
LOAD_ORDER = ("customer_details", "customer_feedback", "device_info", "fraud_alert", "merchant",
              "account_details", "transaction_history")


def run_load(
    spark: SparkSession, in_folder: str, out_folder: str, batch: str | None = None,
    fill_defaults: bool = False, dedupe_batch: bool = False, formats: Formats = None,
    plain: Iterable[str] = (), validate: str | None = None, buckets: int | None = None,
) -> list[LoadResult]:
    """Load every table. The seven are prepared side by side, then committed in order.

    An error while they are prepared leaves all tables as they were; the first one in load
    order is raised. Repeat a failed run with the same ``batch`` to replace what it wrote.
    ``formats`` and ``plain`` go to cleaning and reading, ``buckets`` to the store. With
    ``validate`` the cleaned tables are checked against the constraints before anything is
    written: "stop" raises ``Invalid`` if a row violates one, "report" warns. Results hold
    the NULLs of every column, and the unreadable values that became NULL.
    """
    batch = batch or uuid.uuid4().hex
    raw = as_tables(read_folder(spark, in_folder, plain))
    cleaned = {name: clean(name, raw[name], fill_defaults, formats) for name in TABLES}
    if validate:
        _validate(spark, cleaned, out_folder, validate)

    def one(name: str) -> Prepared:
        made = prepare(spark, cleaned[name], name, out_folder, batch, dedupe_batch, buckets)
        if any(c.lenient for c in TABLES[name].columns):
            lost = {r.column: r.lost for r in unread(name, raw[name], formats).collect()}
            made = replace(made, result=replace(made.result, lost=lost))
        return made

    with ThreadPoolExecutor(len(LOAD_ORDER)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(one), name)
                   for name in LOAD_ORDER]
    errors = [r.exception() for r in running if r.exception()]
    if errors:
        for done in running:
            if not done.exception():
                discard(spark, done.result())
        raise errors[0]
    return [commit(spark, done.result()) for done in running]


class Invalid(RuntimeError):
    """Rows to be loaded violate a declared constraint."""


def batch_violations(
    spark: SparkSession, cleaned: dict[str, DataFrame], out_folder: str,
) -> DataFrame:
    """(table_name, kind, rule, violations) of the rows to be loaded.

    A reference is met by a parent in the batch or in the store.
    """
    from ..plans.constraints import violations  # the plans import this module

    known = dict(cleaned)
    for name in TABLES:
        stored = read_stored(spark, name, f"{out_folder.rstrip('/')}/{name}")
        if stored is not None:
            known[name] = cleaned[name].unionByName(stored.select(*cleaned[name].columns))
    found = None
    for name in LOAD_ORDER:
        lines = violations(Tables({**known, name: cleaned[name]}), name)
        found = lines if found is None else found.unionAll(lines)
    return found


def _validate(
    spark: SparkSession, cleaned: dict[str, DataFrame], out_folder: str, how: str,
) -> None:
    if how not in ("report", "stop"):
        raise ValueError(f"validate is 'report' or 'stop', not {how!r}")
    # One row per constraint of the model that is violated.
    bad = batch_violations(spark, cleaned, out_folder).where("violations > 0").collect()
    if bad:
        text = "; ".join(f"{r.table_name} {r.kind} {r.rule}: {r.violations}" for r in bad)
        if how == "stop":
            raise Invalid(text)
        warnings.warn(text, stacklevel=3)
