"""Registered queries: name to function, name to SQL."""

from waymark.plans import days, fenced, maps, more, panels, places, records  # noqa: F401
from waymark.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
