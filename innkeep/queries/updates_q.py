"""Registered keys: keyed UPDATEs of stored tables (2.1 ``update_rows``) and
column defaults by table definition (2.11 ``apply_defaults``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from innkeep.functions.rules import as_number
from innkeep.plans import jobs as J
from innkeep.plans.bookings_job import ingest_bookings
from innkeep.queries.commands_q import _BOOKINGS_BASE, _CANCEL_BASE, _UPD_BASE, _UPSERT_BASE
from innkeep.registry import register
from innkeep.session import staging_path
from innkeep.sources.ddl import columns, create_tables, defaults, insert_rows
from innkeep.sources.layout import LAYOUT
from innkeep.sources.updates import StoredTable

BUCKETS = 16
STAMP = f"{J.AS_OF} 00:00:00"


def _stored(fx, name: str) -> StoredTable:
    """The table as it is kept: a new copy in the shared folder."""
    keys, uid = LAYOUT[name]
    return StoredTable.create(fx.table(name), staging_path(fx.spark, f"{name}-{uuid.uuid4()}"), keys[0], uid, BUCKETS)


def _out(table: StoredTable, *cols: str):
    kinds = dict(table.read().dtypes)
    cell = {c: F.col(c).cast("double") if kinds[c].startswith("decimal") else F.col(c).cast("string") if kinds[c] == "date" else F.col(c) for c in cols}
    return table.read().select(*[v.alias(c) for c, v in cell.items()], F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def _stamp(hit: str) -> str:
    return f"CASE WHEN {hit} THEN '{STAMP}' END AS updated_at"


@register("update_rows_hotels", _UPSERT_BASE + f""",
ok AS (SELECT * FROM c WHERE code = 'OK'),
upd AS (SELECT hotel_id, arg_max(hotel_name, request_seq) AS hn, arg_max(city, request_seq) AS ci,
               arg_max(country, request_seq) AS co, arg_max(total_rooms, request_seq) AS tr FROM ok GROUP BY hotel_id)
SELECT h.hotel_id, CASE WHEN upd.hotel_id IS NULL THEN h.hotel_name ELSE upd.hn END AS hotel_name,
       CASE WHEN upd.hotel_id IS NULL THEN h.city ELSE upd.ci END AS city,
       CASE WHEN upd.hotel_id IS NULL THEN h.country ELSE upd.co END AS country,
       CASE WHEN upd.hotel_id IS NULL THEN h.total_rooms ELSE CAST(ROUND(TRY_CAST(upd.tr AS DOUBLE)) AS INTEGER) END AS total_rooms,
       {_stamp('upd.hotel_id IS NOT NULL')}
FROM hotels h LEFT JOIN upd ON upd.hotel_id = h.hotel_id
""")
def update_rows_hotels(fx):
    t = _stored(fx, "hotels")
    t.update(J.upsert_hotels(fx).outputs["hotels"], ["hotel_id"],
             {"hotel_name": F.col("hotel_name"), "city": F.col("city"), "country": F.col("country"),
              "total_rooms": F.round(as_number("total_rooms"))}, J.AS_OF)
    return _out(t, "hotel_id", "hotel_name", "city", "country", "total_rooms")


@register("update_rows_rooms", _UPSERT_BASE + f""",
ok AS (SELECT request_seq, hotel_id FROM c WHERE code = 'OK'),
items AS (SELECT o.hotel_id, r.* FROM rs_ r JOIN ok o ON o.request_seq = r.request_seq),
per AS (SELECT hotel_id, room_number,
               arg_max(struct_pack(t := room_type, p := CAST(TRY_CAST(price_per_night AS DOUBLE) AS DECIMAL(10,2)),
                                   a := COALESCE(is_available, true)), struct_pack(s := request_seq, q := pos)) AS u
        FROM items GROUP BY hotel_id, room_number)
SELECT r.room_id, r.hotel_id, r.room_number, COALESCE(p.u.t, r.room_type) AS room_type,
       CAST(CASE WHEN p.hotel_id IS NOT NULL THEN p.u.p ELSE r.price_per_night END AS DOUBLE) AS price_per_night,
       CASE WHEN p.hotel_id IS NOT NULL THEN p.u.a ELSE r.is_available END AS is_available, {_stamp('p.hotel_id IS NOT NULL')}
FROM rooms r LEFT JOIN per p ON p.hotel_id = r.hotel_id AND p.room_number = r.room_number
""")
def update_rows_rooms(fx):
    t = _stored(fx, "rooms")
    t.update(J.upsert_hotels(fx).outputs["rooms_updated"], ["hotel_id", "room_number"],
             {c: F.col(c) for c in ("room_type", "price_per_night", "is_available")}, J.AS_OF)
    return _out(t, "room_id", "hotel_id", "room_number", "room_type", "price_per_night", "is_available")


@register("update_rows_services", _UPSERT_BASE + f""",
ok AS (SELECT request_seq, hotel_id FROM c WHERE code = 'OK'),
upd AS (SELECT o.hotel_id, s.service_id, arg_max(struct_pack(n := s.service_name, c := s.service_charge),
                                                 struct_pack(a := s.request_seq, b := s.pos)) AS u
        FROM ss s JOIN ok o ON o.request_seq = s.request_seq GROUP BY o.hotel_id, s.service_id)
SELECT x.service_id, x.hotel_id, CASE WHEN upd.hotel_id IS NULL THEN x.service_name ELSE upd.u.n END AS service_name,
       CAST(CASE WHEN upd.hotel_id IS NULL THEN x.service_charge
                 ELSE CAST(TRY_CAST(upd.u.c AS DOUBLE) AS DECIMAL(10,2)) END AS DOUBLE) AS service_charge, {_stamp('upd.hotel_id IS NOT NULL')}
FROM services x LEFT JOIN upd ON upd.hotel_id = x.hotel_id AND upd.service_id = x.service_id
""")
def update_rows_services(fx):
    t = _stored(fx, "services")
    t.update(J.upsert_hotels(fx).outputs["services_updated"], ["hotel_id", "service_id"],
             {"service_name": F.col("service_name"), "service_charge": as_number("service_charge")}, J.AS_OF)
    return _out(t, "service_id", "hotel_id", "service_name", "service_charge")


@register("update_rows_room_flags", _BOOKINGS_BASE + f"""
SELECT r.room_id, r.hotel_id, r.room_number, CASE WHEN x.hotel_id IS NOT NULL THEN false ELSE r.is_available END AS is_available,
       {_stamp('x.hotel_id IS NOT NULL')}
FROM rooms r LEFT JOIN (SELECT DISTINCT hotel_id, room_number FROM holder) x ON x.hotel_id = r.hotel_id AND x.room_number = r.room_number
""")
def update_rows_room_flags(fx):
    t = _stored(fx, "rooms")
    t.update(ingest_bookings(fx).outputs["rooms_taken"].distinct(), ["hotel_id", "room_number"], {"is_available": F.lit(False)}, J.AS_OF)
    return _out(t, "room_id", "hotel_id", "room_number", "is_available")


@register("update_rows_booking_status", _CANCEL_BASE + f"""
SELECT b.booking_id, b.hotel_id, CASE WHEN x.booking_id IS NOT NULL THEN 'Cancelled' ELSE b.booking_status END AS booking_status,
       {_stamp('x.booking_id IS NOT NULL')}
FROM bookings b LEFT JOIN (SELECT DISTINCT booking_id FROM ok) x ON x.booking_id = b.booking_id
""")
def update_rows_booking_status(fx):
    t = _stored(fx, "bookings")
    t.update(J.cancel_bookings(fx).outputs["bookings_changes"], ["hotel_id", "booking_id"], {"booking_status": F.col("booking_status")}, J.AS_OF)
    return _out(t, "booking_id", "hotel_id", "booking_status")


@register("update_rows_maintenance", _UPD_BASE + f""",
acc AS (SELECT maintenance_id, hotel_id, room_number, arg_max(req, request_seq) AS new_status
        FROM ch WHERE req <> cur GROUP BY maintenance_id, hotel_id, room_number)
SELECT m.maintenance_id, m.hotel_id, m.room_number, COALESCE(acc.new_status, m.maintenance_status) AS maintenance_status,
       {_stamp('acc.new_status IS NOT NULL')}
FROM maintenance m LEFT JOIN acc ON acc.maintenance_id = m.maintenance_id AND acc.hotel_id = m.hotel_id AND acc.room_number = m.room_number
""")
def update_rows_maintenance(fx):
    t = _stored(fx, "maintenance")
    t.update(J.update_maintenance(fx).outputs["changes"], ["maintenance_id", "hotel_id", "room_number"],
             {"maintenance_status": F.col("maintenance_status")}, J.AS_OF)
    return _out(t, "maintenance_id", "hotel_id", "room_number", "maintenance_status")


# -- defaults ----------------------------------------------------------------------
def _default_sql() -> str:
    values = {"star_rating": "NULL", "room_type": "'Standard'", "is_available": "'true'", "booking_status": "'Confirmed'",
              "maintenance_status": "'Pending'", "resolved": "'false'", "created_at": f"'{STAMP}'", "updated_at": f"'{STAMP}'"}
    return "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, {LAYOUT[t][1] if t != 'hotels' else 'hotel_id'} AS id, '{c}' AS column_name, "
                                f"CAST({values[c]} AS VARCHAR) AS value FROM {t}" for t in LAYOUT for c in defaults(t))


@register("apply_defaults_tables", _default_sql())
def apply_defaults_tables(fx):
    """Every DEFAULT of the ten tables: rows inserted without these columns
    get them from the table definition."""
    spark, name = fx.spark, uuid.uuid4().hex
    database, place = f"innkeep_{name}", staging_path(fx.spark, f"defaults-{name}")
    create_tables(spark, database, place, as_of=STAMP)
    out = None
    for t in LAYOUT:
        left_out = list(defaults(t))
        rows = fx.table(t)
        insert_rows(spark, database, t, rows.select(*[c for c, _ in columns(t) if c not in left_out and c in rows.columns]))
        key = LAYOUT[t][1] if t != "hotels" else "hotel_id"
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in left_out])
        part = spark.read.parquet(f"{place}/{t}").select(F.lit(t).alias("table_name"), F.col(key).alias("id"), F.inline(cells))
        out = part if out is None else out.unionByName(part)
    spark.sql(f"DROP DATABASE {database} CASCADE")      # the files are external and stay
    return out
