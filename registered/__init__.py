"""The queries that run on the given tables, each with its SQL twin."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every module of registered queries and return the collection."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return importlib.import_module(f"{__name__}.book")
