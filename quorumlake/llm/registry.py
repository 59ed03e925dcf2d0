"""Queries of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("overlap", "consensus", "pairs", "neighbours", "toxicity", "leakage", "mixing", "encodings")


def load() -> tuple[dict, dict]:
    """Query functions and their SQL."""
    queries, sql = {}, {}
    for name in MODULES:
        m = import_module(f"quorumlake.llm.{name}")
        queries |= m.QUERIES
        sql |= getattr(m, "SQL", {})
    return queries, sql
