"""Queries over the driver's tables, and the SQL that says what they return."""

from . import graph_queries, kernel_queries, phasing_queries, pileup_queries, scalar_queries, source_queries  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
