"""Named queries over the standard tables, each with its DuckDB equivalent."""

from __future__ import annotations

from . import ingest, lossy, metrics, signals, similarity  # noqa: F401  they register their queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
