"""Imports every module that registers queries."""

from gristmill.plans import answers, cards, details, flows, gatekeeping, mechanisms, search, sheets, words  # noqa: F401
from gristmill.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
