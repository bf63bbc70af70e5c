"""Imports every query module so their ``@register`` calls run."""

from quarry.plans import (adaptive_queries, answer_queries, entity_queries, language_queries,  # noqa: F401
                          text_queries, vector_queries)
from quarry.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
