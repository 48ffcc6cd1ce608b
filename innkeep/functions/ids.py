"""Business-key helpers: prefixed, zero-padded ids and their numeric suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad5(prefix: str, n: Column) -> Column:
    """``prefix + String(n).padStart(5, "0")``: pads to five digits and never
    truncates (``lpad`` would cut ``100000`` to ``10000``)."""
    return F.when(n.isNotNull(), F.format_string(prefix + "%05d", n.cast("long")))


def digits_number(id_col: Column) -> Column:
    """``Number(id.replace(/\\D/g, ""))``: every digit of the id, concatenated;
    an id without digits gives 0."""
    d = F.regexp_replace(id_col, r"[^0-9]", "")
    return F.when(id_col.isNotNull(),
                  F.coalesce(d.try_cast("bigint"), F.lit(0)).cast("long"))


def unsigned_suffix(id_col: Column, start: int) -> Column:
    """``CAST(SUBSTRING(id, start) AS UNSIGNED)`` (1-based start): the leading
    run of digits of the suffix; no digits gives 0."""
    # the numeric conversion skips ASCII whitespace only
    lead = F.regexp_extract(F.substring(id_col, start, 1 << 30), r"^[ \t\n\x0B\f\r]*([0-9]+)", 1)
    return F.when(id_col.isNotNull(),
                  F.coalesce(lead.try_cast("bigint"), F.lit(0)).cast("long"))
