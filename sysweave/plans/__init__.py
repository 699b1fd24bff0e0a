"""Registered queries over the given tables."""

from __future__ import annotations

import importlib

MODULES = ["graph", "trace", "text", "relations", "streams"]


def load():
    """(queries, sql) by name."""
    from sysweave.plans import registry

    for name in MODULES:
        importlib.import_module(f"sysweave.plans.{name}")
    return dict(registry.QUERIES), dict(registry.SQL)
