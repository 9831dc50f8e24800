"""Importing this package fills the query registry."""

import importlib
import pkgutil

from driftgrid.catalog.base import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    importlib.import_module(f"{__name__}.{_m}")

__all__ = ["ORACLES", "QUERIES"]
