"""Registered queries over the input tables."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules

_BASE = {"registry", "fixtures"}


def load() -> dict:
    """Import every query module and return the registry."""
    for m in iter_modules(__path__):
        if m.name not in _BASE:
            import_module(f"{__name__}.{m.name}")
    from weekpanel.workload.registry import QUERIES

    return QUERIES
