"""Queries over the driver's tables, by theme; importing this package registers them all."""

from docloom.plans import filings, finance, search, texts, upkeep  # noqa: F401
from docloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
