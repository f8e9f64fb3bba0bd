"""Every operator and scenario as a query on the order tables, next to the SQL that gives the same rows."""

from palmares.catalog import aggregate, column, evaluate, join, model, scan, scenario, window  # noqa: F401
from palmares.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
