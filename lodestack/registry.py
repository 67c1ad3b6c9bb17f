"""All registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from . import code_queries, edit_queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "code_queries", "edit_queries"]
