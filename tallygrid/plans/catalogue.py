"""All named queries, gathered from the subject modules."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

SUBJECTS = ["sales", "inventory", "pareto", "customers", "quality", "loading", "demand",
            "ensemble", "features", "fitted", "diagnostics", "events"]


def _load() -> None:
    for subject in SUBJECTS:
        try:
            importlib.import_module(f".{subject}", __package__)
        except ModuleNotFoundError as missing:
            if missing.name != f"{__package__}.{subject}":
                raise


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
