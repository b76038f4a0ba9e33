"""Importing this module registers every query."""

from ferrytrace.plans import aggregates, flows, loglines, reports, scalars, scans, streams  # noqa: F401
from ferrytrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
