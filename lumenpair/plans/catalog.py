"""All registered queries."""

from . import retrieval_queries, score_queries, table_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
