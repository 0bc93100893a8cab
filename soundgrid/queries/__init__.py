"""Registered queries, grouped by subject."""
from __future__ import annotations

import importlib

MODULES = ["levels", "motion", "spans", "tones", "study", "forms", "bodies", "audio", "live", "matches"]


def load():
    for m in MODULES:
        importlib.import_module(f"soundgrid.queries.{m}")
    from soundgrid.queries.registry import REGISTRY

    return REGISTRY
