"""Queries over the driver's tables, by name, and their SQL counterparts."""

from . import layout_queries, note_queries, store_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
