"""Query plans over the reference surface, registered by area."""

from __future__ import annotations

import importlib

AREAS = ("relational", "windows", "dialect", "statements")


def register_all() -> None:
    """Import every area once; importing registers its queries."""
    for area in AREAS:
        importlib.import_module(f"basalt.plans.{area}")
