"""Registered queries of the library: importing this package fills the registry."""

from ragmill.plans import analytics_queries, answer_queries, ingest_queries, library_queries, retrieval_queries, stream_queries, text_queries  # noqa: F401
from ragmill.plans.registry import ORACLES, QUERIES  # noqa: F401
