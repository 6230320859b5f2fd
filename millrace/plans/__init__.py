"""Registered queries, each over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib

#: Modules with queries() and oracle_sql().
NAMES = ["projections", "relations", "series", "text", "statistics", "models", "monitoring", "pipelines", "storage"]


def modules() -> list:
    found = []
    for name in NAMES:
        try:
            found.append(importlib.import_module(f"millrace.plans.{name}"))
        except ModuleNotFoundError as e:
            if e.name != f"millrace.plans.{name}":
                raise
    return found
