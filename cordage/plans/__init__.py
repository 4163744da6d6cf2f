"""The registered queries; importing this package enters them all."""

from . import call_queries, corpus_queries, queries, rule_queries, stream_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "call_queries", "corpus_queries", "queries", "rule_queries", "stream_queries"]
