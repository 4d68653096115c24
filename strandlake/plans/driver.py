"""All queries over the driver's tables."""

from __future__ import annotations

from . import graph_queries, interval_queries, kmer_queries, read_queries, variant_queries, vector_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
