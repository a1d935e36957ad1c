"""The KPI and customer views of stored tables, kept up to date per batch (16.1, 16.3).

For every load of transactions its share of both views is stored once: sums, counts and
maxima, which add up over loads. A view is the sum of the shares of the loads that make up
the table now, so a new batch is the only one that is scanned and a repeated batch, a load
of its own, takes the place of its earlier share.

The KPI view needs each customer's region. Customers are only ever added, so what was
joined stays right; transactions without a customer are kept apart by customer_id and meet
the customers again when the view is read. Only if a batch of customers was itself repeated
are the shares that were made with it made again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.rollup import combined, rollup
from ..session import released_shuffles
from ..sources import files
from ..sources.store import read_loads
from ..tables import StoredTables, Tables
from .common import CUSTOMERS, TXN
from .views import (
    KPI_FACETS, KPI_KEYS, customer_360, kpi_columns, kpi_shares, merged_per_customer, per_customer,
)


class Stale(RuntimeError):
    """A load of transactions has no share yet: ``refresh`` first."""


class KeptViews:
    """Shares in ``folder`` of the views of the tables stored in ``tables_folder``."""

    def __init__(self, spark: SparkSession, tables_folder: str, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._tables_folder = tables_folder.rstrip("/")

    def _known(self) -> dict[str, list[tuple[str, frozenset[str]]]]:
        """By load of transactions: its whole shares and the customer loads they were made with."""
        if not files.exists(self._spark, self._folder):
            return {}
        found: dict[str, list] = {}
        for name, place in files.children(self._spark, self._folder).items():
            if files.exists(self._spark, f"{place}/made.json"):
                with_ = frozenset(json.loads(files.read(self._spark, f"{place}/made.json")))
                found.setdefault(name.split(".")[0], []).append((place, with_))
        return found

    def _valid(self, t: StoredTables) -> dict[str, str | None]:
        """The share of every load of transactions that makes up the table now."""
        known, customers = self._known(), t.loads(CUSTOMERS)
        return {load: next((place for place, with_ in known.get(load, [])
                            if with_ <= set(customers)), None) for load in t.loads(TXN)}

    def refresh(self) -> list[str]:
        """Makes the shares that are missing; the loads of transactions that were scanned."""
        t = StoredTables(self._spark, self._tables_folder)
        missing = [load for load, place in self._valid(t).items() if place is None]
        for load in missing:
            self._make(t, load)
        return missing

    def _make(self, t: StoredTables, load: str) -> None:
        place = f"{self._folder}/{load}.{uuid.uuid4().hex}"
        rows = read_loads(self._spark, TXN, f"{self._tables_folder}/{TXN}", [load])
        owners = t.scan(CUSTOMERS)
        of_load = Tables({TXN: rows, CUSTOMERS: owners})
        lost = rows.where("customer_id IS NOT NULL").join(
            owners.select("customer_id"), "customer_id", "left_anti")
        unmatched = rollup(Tables({TXN: lost}), TXN, ["customer_id", *KPI_KEYS], KPI_FACETS)
        with released_shuffles(self._spark):
            kpi_shares(of_load).write.parquet(f"{place}/matched")
            unmatched.write.parquet(f"{place}/unmatched")
            per_customer(of_load).write.parquet(f"{place}/per_customer")
        # Without this file, which comes last, the share does not count.
        files.create(self._spark, f"{place}/made.json", json.dumps(sorted(t.loads(CUSTOMERS))))

    def _shares(
        self, t: StoredTables, part: str, empty: Callable[[Tables], DataFrame],
    ) -> DataFrame:
        places = self._valid(t)
        if None in places.values():
            raise Stale(f"{sum(p is None for p in places.values())} loads without a share")
        if not places:
            return empty(t)
        paths = [f"{place}/{part}" for place in places.values()]
        schema = self._spark.read.parquet(paths[0]).schema
        return self._spark.read.schema(schema).parquet(*paths)

    def executive_kpis(self) -> DataFrame:
        """What ``views.executive_kpis`` gives on the stored tables."""
        t = StoredTables(self._spark, self._tables_folder)
        matched = self._shares(t, "matched", kpi_shares)
        unmatched = self._shares(t, "unmatched", lambda x: rollup(
            x, TXN, ["customer_id", *KPI_KEYS], KPI_FACETS))
        late = unmatched.join(t.scan(CUSTOMERS, "customer_id", "region"), "customer_id")
        both = matched.unionByName(late.select(*matched.columns))
        return kpi_columns(combined(
            both, TXN, ["region", *(getattr(k, "name", k) for k in KPI_KEYS)], KPI_FACETS))

    def customer_360(self, exact: bool = False) -> DataFrame:
        """What ``views.customer_360`` gives; all tables but the transactions are read anew."""
        t = StoredTables(self._spark, self._tables_folder)
        shares = self._shares(t, "per_customer", per_customer)
        return customer_360(t, exact, merged_per_customer(shares))

    def write(self, folder: str) -> list[str]:
        """Refreshes, and stores both views as Parquet; the loads that were scanned."""
        scanned = self.refresh()
        kpis = self.executive_kpis().hint("rebalance", "year_month")
        kpis.write.mode("overwrite").partitionBy("year_month").parquet(
            f"{folder}/vw_executive_kpis")
        self.customer_360().write.mode("overwrite").parquet(f"{folder}/vw_customer_360")
        return scanned

    def clean_up(self, older_than_hours: float = 24.0) -> int:
        """Removes shares that no view needs now, and unfinished ones; how many."""
        used = set(self._valid(StoredTables(self._spark, self._tables_folder)).values())
        gone = 0
        if not files.exists(self._spark, self._folder):
            return gone
        for place in files.children(self._spark, self._folder).values():
            if place not in used and files.age_hours(self._spark, place) >= older_than_hours:
                files.remove(self._spark, place)
                gone += 1
        return gone
