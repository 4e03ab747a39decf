"""The registered queries over live tables, with the SQL that gives the same rows."""

from tidemark.plans import changelog_queries, conversion_queries, engine_queries, maintenance_queries, sql_queries  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
