"""Named queries over the canonical tables, each with its SQL oracle if it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.testmap import Tables, facts, rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SUBJECTS: dict[str, str] = {}


def query(name: str, sql: str | None = None, bare: bool = False):
    """Register ``build(tables)`` under a name.

    ``sql`` is read after the canonical-table prefix, or as it stands if ``bare``.
    """
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        _SUBJECTS[name] = build.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            ORACLES[name] = sql if bare else facts(sql)
        return build
    return register


def subject_of(name: str) -> str:
    """Subject module a query was registered by."""
    return _SUBJECTS[name]


__all__ = ["QUERIES", "ORACLES", "query", "rounded", "Tables"]
