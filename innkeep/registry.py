"""Registry of every answer and job as a (Spark plan, oracle SQL) pair.

``QUERIES[key](fx)`` builds the Spark DataFrame over a :class:`Fixtures`;
``ORACLE[key]`` is the DuckDB statement with the same columns and rows (keys
without one get a rows-only check).  Parameters are fixed values so both
sides answer the same question.  Modules below register their keys on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from innkeep.oracle.views import with_views
from innkeep.sources.fixtures import Fixtures

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ORACLE_RAW: dict[str, str] = {}   # the same SQL over domain tables by name (no fixture views)


def register(key: str, sql: str | None = None):
    def deco(fn: Callable[[Fixtures], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = with_views(sql)
            ORACLE_RAW[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register keys."""
    from innkeep.queries import (  # noqa: F401
        composites, scans, joins, aggregations, sorting, functions_q, commands_q, quality_q, children_q, updates_q)
