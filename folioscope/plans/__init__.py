"""Named queries: operators bound to tables, each with the SQL that must give the same rows where SQL can say it."""

from . import chunk_queries, claim_queries, entity_queries, gap_queries, graph_queries, paper_queries, review_queries, sequence_queries, store_queries, text_queries, vector_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chunk_queries", "claim_queries", "entity_queries", "gap_queries", "graph_queries", "paper_queries", "review_queries", "sequence_queries", "store_queries", "text_queries", "vector_queries"]
