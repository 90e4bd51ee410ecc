"""All queries of this library but the training-data ones."""

from . import command_queries, content_queries, gate_queries, log_queries, source_queries, stat_queries, store_queries, text_queries, tree_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "command_queries", "content_queries", "gate_queries", "log_queries", "source_queries", "stat_queries", "store_queries", "text_queries", "tree_queries"]
