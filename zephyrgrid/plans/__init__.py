"""Registered queries with their checks."""

from __future__ import annotations

import importlib

MODULES = ["observations", "grids", "rollups", "energy", "series", "modelling", "streams", "refresh"]


def load_all():
    """Import every query module and return the catalogue they registered in."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.catalog")
