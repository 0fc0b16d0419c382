"""Registered queries: importing this package fills QUERIES and ORACLE_SQL."""

from recordspark.plans import extract_queries, linkage_queries, mining_queries, review_queries, source_queries, text_queries, workflow_queries  # noqa: F401
from recordspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
