"""Queries over the given tables."""

from . import (  # noqa: F401
    bandit_queries,
    file_queries,
    ingest_queries,
    score_queries,
    vector_queries,
    work_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
