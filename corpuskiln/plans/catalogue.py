"""All queries of the core, and their SQL."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("text_queries", "table_queries", "sequence_queries", "score_queries", "stream_queries", "row_queries", "source_queries", "token_queries")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _family in FAMILIES:
    _module = import_module(f"{__package__}.{_family}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
