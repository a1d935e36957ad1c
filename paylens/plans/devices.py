"""Step 8: devices and security."""

from __future__ import annotations

from ..functions.calendar import days_before
from ..operators.rollup import rollup, rollup_through
from ..operators.shares import with_share
from .catalog import report
from .common import CUSTOMERS, DEVICES, desc, n, named, rate


@report("q8_01_rooted_share", by="is_rooted")
@report("q8_03_app_versions", by="app_version")
def devices_by(t, by):
    counted = rollup(t, DEVICES, [by], "rows").withColumnRenamed("rows", "device_count")
    return with_share(counted, "device_count").orderBy(desc("device_count"), by)


@report("q8_02_rooted_by_region")
def rooted_by_region(t):
    return rollup_through(
        t, DEVICES, CUSTOMERS, "customer_id", ["region"], "rows ids rooted"
    ).select(
        "region", n("ids", "total_devices"), n("rooted", "rooted_devices"),
        rate("rooted", "rooted_pct"),
    ).orderBy(desc("rooted_pct"), "region")


@report("q8_04_stale_devices", clock="transactions")
def stale_devices(t, as_of=None, days=90):
    end = days_before(as_of, days)
    idle = t.within(DEVICES, "last_active", until=end).scan(DEVICES, "last_active")
    idle = idle.where(f"last_active < {end}")
    return idle.agg(named("count(1)", f"inactive_{days}_days_count"))


@report("q8_05_rooted_by_device_type")
def rooted_by_device_type(t):
    return rollup(t, DEVICES, ["device_type"], "rows rooted").select(
        "device_type", n("rows", "total_devices"), n("rooted", "rooted_count"),
        rate("rooted", "rooted_pct"),
    ).orderBy(desc("rooted_pct"), "device_type")
