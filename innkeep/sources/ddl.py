"""The ten domain tables as catalog tables with column defaults.

``create_tables`` issues the CREATE TABLE statements; an INSERT that leaves
columns out gets their DEFAULTs from the table, as in the service's database.
Columns follow the tables as the library reads them, with the defaults of the
service's definitions; ``created_at`` and ``updated_at`` default to
CURRENT_TIMESTAMP, or to ``as_of`` where a job has to be repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from innkeep.sources.frames import SCHEMAS
from innkeep.sources.layout import LAYOUT

# DEFAULTs of the table definitions (SQL expressions).
DEFAULTS = {
    "hotels": {"star_rating": "NULL"},
    "rooms": {"room_type": "'Standard'", "is_available": "TRUE"},
    "bookings": {"booking_status": "'Confirmed'"},
    "maintenance": {"maintenance_status": "'Pending'", "resolved": "FALSE"},
}
EXTRA = {"maintenance": "resolved boolean"}     # a column of the definition that the service's code never names


def columns(name: str) -> list[tuple[str, str]]:
    """(column, type) of a domain table, with its stamps."""
    text = SCHEMAS[name] + (", " + EXTRA[name] if name in EXTRA else "")
    found = [tuple(part.split(None, 1)) for part in _split(text)]
    return [c for c in found if c[0] != "created_at"] + [("created_at", "timestamp_ntz"), ("updated_at", "timestamp_ntz")]


def _split(text: str) -> list[str]:
    """The column definitions of a schema text (commas in a type's brackets stay)."""
    out, depth = [""], 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return [p.strip() for p in out]


def defaults(name: str, as_of: str | None = None) -> dict[str, str]:
    now = f"TIMESTAMP_NTZ'{as_of}'" if as_of else "LOCALTIMESTAMP()"
    return {**DEFAULTS.get(name, {}), "created_at": now, "updated_at": now}


def create_statement(database: str, name: str, location: str, as_of: str | None = None) -> str:
    own = defaults(name, as_of)
    cols = ", ".join(f"{c} {t}" + (f" DEFAULT {own[c]}" if c in own else "") for c, t in columns(name))
    return f"CREATE TABLE {database}.{name} ({cols}) USING parquet LOCATION '{location}/{name}'"


def create_tables(spark: SparkSession, database: str, location: str, as_of: str | None = None, names=tuple(LAYOUT)) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in names:
        spark.sql(create_statement(database, name, location, as_of))


def insert_rows(spark: SparkSession, database: str, name: str, rows: DataFrame) -> None:
    """INSERT with the columns that ``rows`` has; the table fills in the rest."""
    cols = ", ".join(rows.columns)
    spark.sql(f"INSERT INTO {database}.{name} ({cols}) SELECT {cols} FROM {{rows}}", rows=rows)
