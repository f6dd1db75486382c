"""Registered queries: one module per part of the library."""

import importlib
import pkgutil


def load():
    from gridwright.queries.registry import QUERIES
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return QUERIES


def oracles():
    load()
    from gridwright.queries.registry import ORACLES
    return ORACLES
