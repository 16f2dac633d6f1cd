"""Registered queries: every operator over the given tables, with its SQL twin where one exists."""

from catalog.common import ORACLE, QUERIES
from catalog import sources, projections, joins, aggregates, windows, models, reports  # noqa: F401

__all__ = ["QUERIES", "ORACLE"]
