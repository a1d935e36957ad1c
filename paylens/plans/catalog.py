"""Every report by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Report:
    name: str
    build: Callable[..., DataFrame]
    clock: str | None  # which of the callers' clocks ``as_of`` should follow

    def __call__(self, tables, as_of=None, **params) -> DataFrame:
        if self.clock:
            params["as_of"] = as_of
        return self.build(tables, **params)


REPORTS: dict[str, Report] = {}


def report(name: str, /, clock: str | None = None, **fixed):
    """Register a function of the tables; ``fixed`` binds some of its parameters."""

    def register(build):
        bound = build
        if fixed:
            def bound(tables, **params):
                return build(tables, **{**fixed, **params})
        if name in REPORTS:
            raise ValueError(f"two reports named {name}")
        REPORTS[name] = Report(name, bound, clock)
        return build

    return register
