"""The report library. ``REPORTS`` maps a name to a function of the tables."""

from . import (  # noqa: F401
    accounts, constraints, customers, derived, devices, executive, explore, fraud, intake, kpi,
    merchants, pending, profile, reversals, satisfaction, statistics, validation, views,
)
from .catalog import REPORTS

__all__ = ["REPORTS"]
