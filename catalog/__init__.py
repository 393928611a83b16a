"""Registered queries and the SQL each is checked against."""

from catalog import audit, cleaning, exploration, features, scans, statistics  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
