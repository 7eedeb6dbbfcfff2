"""Operators for preparing training data, and their queries on the given tables."""

from musterline.llm.queries import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
