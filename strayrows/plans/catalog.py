"""All registered queries."""

from strayrows.plans import detect_queries, group_queries, model_queries, rule_queries, table_queries  # noqa: F401
from strayrows.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
