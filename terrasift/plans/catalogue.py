"""All registered queries and their SQL."""

from terrasift.plans import zone_queries  # noqa: F401  registers its queries
from terrasift.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
