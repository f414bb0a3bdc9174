"""Queries of the tick analytics engine over the driver's tables."""

from tapeline.plans import entities, evidence, feeds, market  # noqa: F401
from tapeline.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
