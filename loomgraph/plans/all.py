"""All query modules."""

from loomgraph.plans import cross_queries, document_queries, function_queries, graph_queries, merge_queries, more_queries, record_queries, stream_queries, text_queries, vocabulary_queries  # noqa: F401
from loomgraph.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
