"""Queries over the example tables; importing a module registers its queries."""

from . import graph_queries, model_queries, more_queries, overlap_queries, prep_queries, quality_queries, stream_queries, study_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
