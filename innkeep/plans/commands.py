"""Shared pieces of the command (write) jobs: lookups and reject tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.operators.filters import unique_keys


def lookup_codes(requests: DataFrame, checks: Sequence[tuple[str, DataFrame, str]],
                 seq: str = "request_seq") -> DataFrame:
    """(request_seq, code): the first failing existence check, else 'OK'.

    Each check is (key column, table holding that key, reject code): one left
    join with the table's distinct keys, so requests are read once and a hot
    key is a splittable left side."""
    code = F.lit("OK")
    out = requests
    for i, (key, table, _) in enumerate(checks):
        known = unique_keys(table, [key]).select(F.col(key).alias(f"_key{i}"))
        out = out.join(known, F.col(key) == F.col(f"_key{i}"), "left")
    for i, (_, _, reject) in reversed(list(enumerate(checks))):
        code = F.when(F.col(f"_key{i}").isNull(), F.lit(reject)).otherwise(code)
    return out.select(seq, code.alias("code"))
