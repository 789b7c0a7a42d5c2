"""Queries on the test tables: one or more per operator."""

from rolltally.catalog import (  # noqa: F401  (importing registers the queries)
    answers,
    distill,
    evaluation,
    joins,
    prompts,
    rollouts,
    sampling,
    sequences,
    sources,
    streams,
)
from rolltally.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
