"""Registered keys: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from innkeep.operators import aggregates as agg
from innkeep.operators.filters import unique_keys
from innkeep.operators.ranking import rank_within_groups
from innkeep.oracle.sqlparts import AGG_CTES, AVG_RATING
from innkeep.plans.directory import HotelAnswers
from innkeep.registry import register


def _customer_names(fx):
    return fx.customers().select("customer_id", F.col("full_name").alias("customer_name"))


@register("join_inner_hotel", """
SELECT b.booking_id, b.hotel_id, h.hotel_name FROM bookings b JOIN hotels h ON b.hotel_id = h.hotel_id
""")
def join_inner_hotel(fx):
    return (fx.bookings().join(fx.hotels().select("hotel_id", "hotel_name"), "hotel_id")
            .select("booking_id", "hotel_id", "hotel_name"))


@register("join_left_customer", """
SELECT b.booking_id, b.customer_id, c.full_name AS customer_name
FROM bookings b LEFT JOIN customers c ON b.customer_id = c.customer_id
""")
def join_left_customer(fx):
    return (fx.bookings().join(_customer_names(fx), "customer_id", "left")
            .select("booking_id", "customer_id", "customer_name"))


@register("join_left_derived", """
SELECT r.review_id, r.hotel_id, r.rating, cust.customer_name
FROM reviews r LEFT JOIN (SELECT customer_id, full_name AS customer_name FROM customers) AS cust
  ON r.customer_id = cust.customer_id
""")
def join_left_derived(fx):
    return (fx.reviews().join(_customer_names(fx), "customer_id", "left")
            .select("review_id", "hotel_id", "rating", "customer_name"))


def _chain_sql(lead: str = "", join: str = "") -> str:
    """The full chain as the reference joins it, then counted per room row
    and per cancel row."""
    return f"""
WITH chain AS (
  SELECT {lead} b.booking_id, b.hotel_id, b.booking_status, cust.full_name AS customer_name, br.booking_room_id,
         br.room_number, CAST(br.check_in AS VARCHAR) AS check_in, CAST(br.check_out AS VARCHAR) AS check_out,
         CAST(br.room_amount AS DOUBLE) AS room_amount, bc.booking_cancel_id, bc.cancel_reason
  FROM bookings b
  LEFT JOIN customers cust ON b.customer_id = cust.customer_id
  LEFT JOIN booking_rooms br ON b.booking_id = br.booking_id
  {join}
  LEFT JOIN bookings_cancelled bc ON b.booking_id = bc.booking_id)
SELECT * EXCLUDE (booking_room_id, booking_cancel_id, cancel_reason), booking_room_id AS part_id, 'room' AS kind,
       CAST(NULL AS VARCHAR) AS cancel_reason, COUNT(*) AS chain_rows
FROM chain GROUP BY ALL
UNION ALL BY NAME
SELECT * EXCLUDE (booking_room_id, booking_cancel_id, room_number, check_in, check_out, room_amount),
       booking_cancel_id AS part_id, 'cancel' AS kind, COUNT(*) AS chain_rows
FROM chain WHERE booking_cancel_id IS NOT NULL GROUP BY ALL
"""


def _chain_out(df, *lead):
    return df.select(*lead, "booking_id", "hotel_id", "booking_status", "customer_name", "room_number",
                     F.col("check_in").cast("string").alias("check_in"),
                     F.col("check_out").cast("string").alias("check_out"),
                     F.col("room_amount").cast("double").alias("room_amount"), "part_id", "kind", "cancel_reason",
                     "chain_rows")


@register("join_left_chain", _chain_sql())
def join_left_chain(fx):
    """The chain bookings ⟕ customers ⟕ booking_rooms ⟕ bookings_cancelled,
    nothing dropped: one row per (booking, room) and one per (booking, cancel
    row), each with ``chain_rows``, the number of chain rows it stands for,
    so the product of a booking's rooms and cancel rows is counted, not
    emitted."""
    return _chain_out(agg.booking_chain(fx.bookings(), fx.customers(), fx.booking_rooms(), fx.bookings_cancelled()))


@register("join_mixed_chain", _chain_sql("h.hotel_name,", "JOIN hotels h ON b.hotel_id = h.hotel_id"))
def join_mixed_chain(fx):
    """The history's chain: the same with an inner join to the hotels (rows
    as in ``join_left_chain``)."""
    named = fx.bookings().join(fx.hotels().select("hotel_id", "hotel_name"), "hotel_id")
    return _chain_out(agg.booking_chain(named, fx.customers(), fx.booking_rooms(), fx.bookings_cancelled()), "hotel_name")


@register("join_semi_has_rooms", """
SELECT h.hotel_id, h.hotel_name FROM hotels h WHERE EXISTS (SELECT 1 FROM rooms r WHERE r.hotel_id = h.hotel_id)
""")
def join_semi_has_rooms(fx):
    # distinct keys first: a hot hotel's rooms shrink before the shuffle
    return (fx.hotels().join(fx.rooms().select("hotel_id").distinct(), "hotel_id", "left_semi")
            .select("hotel_id", "hotel_name"))


@register("join_app_lookup", f"""
WITH {AGG_CTES}
SELECT h.hotel_id, CAST(COALESCE(rs.avail, 0) AS BIGINT) AS total_rooms_available,
       {AVG_RATING} AS average_rating, CAST(COALESCE(rv.rcnt, 0) AS BIGINT) AS total_reviews,
       CAST(COALESCE(bk.total_bookings, 0) AS BIGINT) AS total_bookings
FROM hotels h LEFT JOIN rs ON rs.hotel_id = h.hotel_id LEFT JOIN rv ON rv.hotel_id = h.hotel_id
              LEFT JOIN bk ON bk.hotel_id = h.hotel_id
""")
def join_app_lookup(fx):
    """Aggregates looked up onto every hotel, missing -> 0."""
    cards = HotelAnswers(fx)._enrich(fx.hotels().select("id", "hotel_id", "created_at"),
                                      bookings=True, price=False, restrict=False)
    return cards.select("hotel_id", "total_rooms_available",
                        F.col("average_rating").cast("double").alias("average_rating"),
                        "total_reviews", "total_bookings")


@register("join_app_nest", """
SELECT hotel_id, ROW_NUMBER() OVER (PARTITION BY hotel_id ORDER BY id) AS pos,
       room_number, room_type, CAST(price_per_night AS DOUBLE) AS price_per_night, is_available
FROM rooms
""")
def join_app_nest(fx):
    """Children of each hotel in insertion (id) order, as (hotel_id, pos, ..)
    rows: the flat form of the nested ``rooms`` array, numbered by a
    skew-safe distributed rank instead of one collect per hotel."""
    r = fx.rooms().select("id", "hotel_id", "room_number", "room_type", "price_per_night", "is_available")
    return (rank_within_groups(r, ["hotel_id"], ["id"])
            .select("hotel_id", "pos", "room_number", "room_type",
                    F.col("price_per_night").cast("double").alias("price_per_night"), "is_available"))


@register("lookup_exists", """
SELECT q.request_seq,
       CASE WHEN h.hotel_id IS NULL THEN 'HOTEL_NOT_FOUND'
            WHEN c.customer_id IS NULL THEN 'CUSTOMER_NOT_FOUND' ELSE 'OK' END AS code
FROM review_requests q
LEFT JOIN hotels h ON h.hotel_id = trim(q.hotel_id)
LEFT JOIN customers c ON c.customer_id = trim(q.customer_id)
""")
def lookup_exists(fx):
    """First failing existence check per request, by semi/anti joins."""
    from innkeep.functions.text import js_trim
    from innkeep.plans.commands import lookup_codes
    req = (fx.review_requests().withColumn("hotel_id", js_trim("hotel_id"))
           .withColumn("customer_id", js_trim("customer_id")))
    return lookup_codes(req, [("hotel_id", fx.hotels(), "HOTEL_NOT_FOUND"),
                                               ("customer_id", fx.customers(), "CUSTOMER_NOT_FOUND")])


_UPSERT_ITEMS_SQL = """
SELECT q.hotel_id, i.request_seq, i.pos, i.room_number
FROM hotel_request_rooms i JOIN hotel_requests q ON q.request_seq = i.request_seq
WHERE q.hotel_id IS NOT NULL"""


def _upsert_items(fx):
    q = fx.hotel_requests().where(F.col("hotel_id").isNotNull()).select("request_seq", "hotel_id")
    return fx.hotel_request_rooms().join(q, "request_seq").select("hotel_id", "request_seq", "pos", "room_number")


@register("anti_new_rows", f"""
SELECT * FROM ({_UPSERT_ITEMS_SQL}) x
WHERE NOT EXISTS (SELECT 1 FROM rooms r WHERE r.hotel_id = x.hotel_id AND r.room_number = x.room_number)
""")
def anti_new_rows(fx):
    """Request rooms that are not in the hotel yet: to be inserted."""
    return _upsert_items(fx).join(unique_keys(fx.rooms(), ["hotel_id", "room_number"]),
                                  ["hotel_id", "room_number"], "left_anti")


@register("semi_existing_rows", f"""
SELECT * FROM ({_UPSERT_ITEMS_SQL}) x
WHERE EXISTS (SELECT 1 FROM rooms r WHERE r.hotel_id = x.hotel_id AND r.room_number = x.room_number)
""")
def semi_existing_rows(fx):
    """Request rooms already in the hotel: to be updated."""
    return _upsert_items(fx).join(unique_keys(fx.rooms(), ["hotel_id", "room_number"]),
                                  ["hotel_id", "room_number"], "left_semi")
