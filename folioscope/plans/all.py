"""All queries of the author-page engine with their SQL."""

from __future__ import annotations

from . import contents, made_pages, queries, streams, tables  # noqa: F401  each registers its queries
from .register import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
