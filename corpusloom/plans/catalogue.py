"""Every query of the catalogue, gathered from its modules."""

from corpusloom.plans import ingest_queries, maintenance_queries, rule_queries, search_queries, streaming_queries, upkeep_queries  # noqa: F401
from corpusloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
