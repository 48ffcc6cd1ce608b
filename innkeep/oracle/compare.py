"""Differential check: a Spark DataFrame against DuckDB SQL on the same parquet.

Used by the tests and ``scripts/check_oracle.py``; values are normalised the
same way on both sides (decimals -> float, dates/timestamps -> ISO text) and
compared as order-insensitive multisets of rows."""

from __future__ import annotations

import datetime as _dt
import decimal
import math

BASE_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations")


def duck_connect(sf_dir: str):
    import duckdb
    import os
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_VIEWS:
        p = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, bool):
        return bool(v)
    if isinstance(v, int):
        return int(v)
    if isinstance(v, _dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, _dt.date):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    return [cols[i] for i in order], out


def compare(spark_df, sql: str, con, max_diff: int = 5) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    sc, sr = _rows(s_cols, s_rows)
    dc, dr = _rows(d_cols, d_rows)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(sr) != len(dr):
        return False, f"row count differs: spark={len(sr)} duck={len(dr)}"
    if sr != dr:
        from collections import Counter
        a, b = Counter(sr), Counter(dr)
        only_s = list((a - b).elements())[:max_diff]
        only_d = list((b - a).elements())[:max_diff]
        return False, f"values differ; cols={sc}\n spark-only={only_s}\n duck-only={only_d}"
    return True, f"{len(sr)} rows"
