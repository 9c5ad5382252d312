"""Queries over the test tables, each with its SQL twin where SQL can express it."""

from . import analysis_queries, corpus_queries, tagger_queries, text_queries, tool_queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analysis_queries", "corpus_queries", "tagger_queries", "text_queries", "tool_queries"]
