"""All registered queries of the core; the llm subpackage has its own list."""

from __future__ import annotations

from importlib import import_module

MODULES = ("multivalue", "readers", "votes", "agreement", "report", "retrieval", "ordered", "pools", "evaluation", "feedback", "texts", "checks")


def core() -> tuple[dict, dict]:
    """Query functions and their SQL."""
    queries, sql = {}, {}
    for name in MODULES:
        m = import_module(f"quorumlake.plans.{name}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
