"""Queries over the driver's tables, registered by name."""

from catalogkit.plans import catalog, landing, pages, reports, scalar, streams
from catalogkit.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "landing", "pages", "reports", "scalar", "streams"]
