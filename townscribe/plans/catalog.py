"""All queries of the reference's own operators."""

from __future__ import annotations

import importlib

MODULES = ("rollups", "usage", "vectors", "texts", "names", "resolution", "changes", "places", "legal", "rules", "lookups", "streams")


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"townscribe.plans.{m}")
