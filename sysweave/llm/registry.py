"""The queries of this subpackage by name, and their SQL where SQL can state them."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}

MODULES = [
    "quality", "linededup", "bpe", "decontaminate", "neardup", "rules", "html", "urls", "pii", "ngramlm",
    "packing", "periodic", "negatives",
]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load() -> tuple[dict, dict[str, str]]:
    """(queries, sql) of the operators."""
    for name in MODULES:
        importlib.import_module(f"sysweave.llm.{name}")
    return dict(QUERIES), dict(SQL)
