"""Registered queries: each operator over the supplied tables, with SQL to check it."""

from __future__ import annotations

from importlib import import_module

from shelfscan.plans.registry import ORACLES, QUERIES

_FAMILIES = (
    "ranking",
    "relevance",
    "cleaning",
    "checks",
    "catalog",
    "profiling",
    "search",
    "sessions",
    "storage",
)

for _name in _FAMILIES:
    import_module(f"shelfscan.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
