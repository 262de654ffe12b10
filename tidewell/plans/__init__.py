"""All registered queries of the engine."""

from . import record_queries, search_queries, stream_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "record_queries", "search_queries", "stream_queries", "text_queries"]
