"""All queries of the core with the SQL they are compared with."""

from __future__ import annotations

from . import metrics, placement, problems, store, upkeep

_MODULES = (problems, store, upkeep, placement, metrics)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
