"""Registered queries, by inventory."""

from . import analysis, metrics, operations, relational, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "metrics", "operations", "relational", "text"]
