"""Registered queries with their ANSI SQL statements."""

from __future__ import annotations

from importlib import import_module

_AREAS = ("sources", "cleaning", "windows", "folding", "searching", "boxes", "validation", "models", "cotrending", "injection", "stages")


def _registry():
    q, sql = {}, {}
    for area in _AREAS:
        m = import_module(f"starfold.catalog.{area}")
        q.update(m.QUERIES)
        sql.update(m.SQL)
    return q, sql


def all_queries():
    """All queries by name."""
    return _registry()[0]


def all_sql():
    return _registry()[1]
