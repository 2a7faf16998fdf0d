"""Jobs built from the operators, and the queries registered over the tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("claims", "record_rows", "lookups", "digests", "frame_checks", "near_copies", "claim_log", "anchors", "collections", "incremental")


def load_all():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return import_module(f"{__name__}.registry")
