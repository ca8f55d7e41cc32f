"""All registered queries of the library and their SQL."""

from folioframe import design_queries, format_queries, profile_queries  # noqa: F401  they register their queries
from folioframe.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
