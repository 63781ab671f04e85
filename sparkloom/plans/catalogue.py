"""All queries of the catalogue with their SQL oracles."""

from __future__ import annotations

from sparkloom.plans import aggregates, analytics, filters, intake, joins, merging, placement, projections, sinks, text  # noqa: F401  they register themselves
from sparkloom.plans.registry import ORACLES, QUERIES
from sparkloom.streaming import events  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
