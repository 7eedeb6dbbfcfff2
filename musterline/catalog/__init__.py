"""The library's operators on the given tables."""

from musterline.catalog import matching_queries, report_queries, scalar_queries, stream_queries, table_queries  # noqa: F401
from musterline.catalog.registry import CHECKS, QUERIES, run

__all__ = ["CHECKS", "QUERIES", "run"]
