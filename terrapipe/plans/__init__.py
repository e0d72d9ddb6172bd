"""The queries of the engine, by name."""

from . import rules, text, weather  # noqa: F401, I001
from . import advanced, ingestion, legacy, reports, review, streams  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
