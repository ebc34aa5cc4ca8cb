"""All queries of the engine."""

from siltstone.plans import corpus_queries, cost_queries, more_queries, process_queries, service_queries, text_queries  # noqa: F401  (they register themselves)
from siltstone.plans.registry import QUERIES

__all__ = ["QUERIES"]
