"""Registered queries on the supplied tables, each with equivalent SQL where SQL can say it."""

from registry.base import ORACLES, QUERIES
from registry import entity, files, outlier_queries, profiling, report_queries, selection  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
