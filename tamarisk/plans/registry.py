"""The registered queries and their SQL."""

from __future__ import annotations

import inspect

from tamarisk.plans import queries
from tamarisk.plans.oracle import ORACLE

_HELPERS = {"read", "jobs", "pages_a", "pages_b"}
QUERIES = {
    name: f
    for name, f in inspect.getmembers(queries, inspect.isfunction)
    if f.__module__ == queries.__name__ and not name.startswith("_") and name not in _HELPERS
}

__all__ = ["ORACLE", "QUERIES"]
