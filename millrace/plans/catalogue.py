"""Registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from .registry import QUERIES, SQL, query, t
from . import extras, geo_text, io_stream, known, relational, series, statistics, surface, windows  # noqa: F401, E402, I001

__all__ = ["QUERIES", "SQL", "query", "t"]
