"""Registered queries: each operator applied to whole tables, with its DuckDB counterpart."""

from __future__ import annotations

import importlib
import pkgutil
from types import ModuleType


def load() -> ModuleType:
    """Import every ``*_queries`` module and return the filled registry."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.registry")
