"""Queries over the given tables, one per operator."""

from __future__ import annotations

import importlib

_MODULES = ("release", "cells", "ingest", "triples", "references", "checks", "infer", "rules", "ordering", "templates", "observe", "forms", "options")


def load():
    """``(queries, oracles)`` of all plan modules."""
    from listwright.plans import registry

    for name in _MODULES:
        importlib.import_module(f"listwright.plans.{name}")
    return registry.QUERIES, registry.ORACLES
