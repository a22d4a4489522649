"""Registered queries with the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ("validation", "monitoring", "profiling", "schemas", "loading", "retrying", "expressions", "files")


def load_all():
    """(queries, oracle SQL) of all plan modules."""
    for name in MODULES:
        importlib.import_module(f"tidewatch.plans.{name}")
    from tidewatch.plans import catalog

    return catalog.QUERIES, catalog.ORACLES
