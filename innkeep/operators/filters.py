"""Predicates of the read answers, as Column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def like_ci(c: str | Column, text: str) -> Column:
    """``LOWER(c) LIKE '%text%'``: ``%`` and ``_`` typed by the user stay
    wildcards; a NULL column never matches, even for an empty search."""
    return F.lower(_c(c)).like(f"%{(text or '').lower()}%")


def contains_ci(c: str | Column, text: str) -> Column:
    """``c.toLowerCase().includes(text)``: literal substring, case-insensitive.
    NULL is not matched (the reference throws on it)."""
    return F.lower(_c(c)).contains(F.lit((text or "").lower()))


def min_rating(avg_col: str | Column, r: float | None) -> Column:
    """``average >= r``; a missing average counts as 0; r of 0/NaN disables."""
    if not r or r != r:
        return F.lit(True)
    return F.coalesce(_c(avg_col), F.lit(0)) >= F.lit(r)


def is_true(c: str | Column) -> Column:
    """Keep rows whose boolean flag is TRUE (NULL is not kept)."""
    return F.coalesce(_c(c), F.lit(False))


def status_not(c: str | Column, value: str = "Cancelled") -> Column:
    """``status !== value``: NULL passes, comparison is case-sensitive."""
    return ~_c(c).eqNullSafe(F.lit(value))


def unique_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """The distinct keys ``on`` of ``df`` without NULLs, as the right side of an
    existence join.

    Grouped by one more column (always 0), so the join gets an exchange of its
    own on ``on``: AQE splits a hot key only between two plain exchanges, and a
    ``distinct`` on the join's own keys would put an aggregate there."""
    present = F.lit(True)
    for c in on:
        present = present & F.col(c).isNotNull()
    return df.where(present).select(*on, F.pmod(F.xxhash64(*on), F.lit(1)).alias("_one")).distinct().select(*on)
