"""Registered queries with their SQL checks, grouped by topic."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every topic module and return ``(queries, checks)``."""
    from catalog import base

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"catalog.{module}")
    return dict(base.QUERIES), {name: base.oracle(sql) for name, sql in base.SQL.items()}
