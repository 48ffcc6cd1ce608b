"""Registered keys: scans and projections / filters (2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from innkeep.operators import aggregates as agg
from innkeep.operators.filters import contains_ci, is_true, like_ci, min_rating, status_not
from innkeep.oracle.sqlparts import AGG_CTES, AVG_PRICE, AVG_RATING
from innkeep.plans.directory import HotelAnswers, children, newest_hotels, ts_text
from innkeep.queries.composites import CITY_COUNTRY, HISTORY, PRICE_RATING
from innkeep.registry import register

SUBQUERY_BOOKING = "BOOK00001"
CONTAINS_CITY = "nation_2"
LIKE_COUNTRY = "a"
MIN_RATING = 3.0


# -- 2.1 scans ---------------------------------------------------------------
# The column list that is read from each domain table, its key first.
SCAN_COLUMNS = {
    "hotels": ("hotel_id", "hotel_name", "city", "country", "total_rooms", "created_at"),
    "rooms": ("room_id", "hotel_id", "room_number", "room_type", "price_per_night", "is_available"),
    "services": ("service_id", "hotel_id", "service_name", "service_charge"),
    "customers": ("customer_id", "full_name", "email", "phone", "city", "country"),
    "employees": ("employee_id", "hotel_id", "full_name", "role"),
    "bookings": ("booking_id", "hotel_id", "customer_id", "total_amount", "booking_status", "created_at"),
    "booking_rooms": ("booking_room_id", "booking_id", "room_number", "check_in", "check_out", "room_amount"),
    "bookings_cancelled": ("booking_cancel_id", "booking_id", "customer_id", "hotel_id", "total_amount", "cancel_reason"),
    "reviews": ("review_id", "hotel_id", "customer_id", "rating", "comment", "review_date"),
    "maintenance": ("maintenance_id", "hotel_id", "room_number", "employee_id", "maintenance_status"),
}


def _cell_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c == "created_at" else f"CAST({c} AS VARCHAR)"


@register("scan_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {cols[0]} AS id, '{c}' AS column_name, {_cell_sql(c)} AS value FROM {t}"
    for t, cols in SCAN_COLUMNS.items() for c in cols[1:]))
def scan_tables(fx):
    """Every domain table read with its explicit column list, a row for each
    cell (name and value): a scan prunes to these columns (see ReadSchema),
    and each table is read once."""
    out = None
    for t, cols in SCAN_COLUMNS.items():
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), (ts_text(c) if c == "created_at" else F.col(c).cast("string")).alias("value"))
                          for c in cols[1:]])
        part = fx.table(t).select(F.lit(t).alias("table_name"), F.col(cols[0]).alias("id"), F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return out


@register("scan_star", "SELECT * FROM customers")
def scan_star(fx):
    return fx.customers()


@register("scan_star_hotels", "SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at) FROM hotels")
def scan_star_hotels(fx):
    return fx.hotels().withColumn("created_at", ts_text("created_at"))


@register("scan_star_bookings", "SELECT * REPLACE (strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, "
                                "CAST(total_amount AS DOUBLE) AS total_amount) FROM bookings")
def scan_star_bookings(fx):
    return fx.bookings().withColumn("created_at", ts_text("created_at")).withColumn("total_amount", F.col("total_amount").cast("double"))


# -- 2.2 projections and filters ------------------------------------------------
@register("project_alias", """
SELECT b.booking_id, b.hotel_id, c.full_name AS customer_name, b.booking_status AS status,
       CAST(b.total_amount AS DOUBLE) AS total_amount
FROM bookings b LEFT JOIN customers c ON b.customer_id = c.customer_id
""")
def project_alias(fx):
    cust = fx.customers().select("customer_id", F.col("full_name").alias("customer_name"))
    return (fx.bookings().join(cust, "customer_id", "left")
            .select("booking_id", "hotel_id", "customer_name", F.col("booking_status").alias("status"),
                    F.col("total_amount").cast("double").alias("total_amount")))


@register("filter_key_eq", f"""
SELECT booking_id, hotel_id, booking_status FROM bookings WHERE customer_id = '{HISTORY['customer_id']}'
""")
def filter_key_eq(fx):
    return (fx.bookings().where(F.col("customer_id") == F.lit(HISTORY["customer_id"]))
            .select("booking_id", "hotel_id", "booking_status"))


@register("filter_in_list", """
SELECT hotel_id, room_number, room_type, is_available FROM rooms
WHERE hotel_id IN (SELECT hotel_id FROM hotels ORDER BY created_at DESC, id LIMIT 10)
""")
def filter_in_list(fx):
    return children(fx, "rooms", newest_hotels(fx, 1)).select("hotel_id", "room_number", "room_type", "is_available")


@register("filter_in_subquery", f"""
SELECT room_id, hotel_id, room_number FROM rooms
WHERE room_number IN (SELECT room_number FROM booking_rooms WHERE booking_id = '{SUBQUERY_BOOKING}')
""")
def filter_in_subquery(fx):
    wanted = (fx.booking_rooms().where(F.col("booking_id") == SUBQUERY_BOOKING)
              .select("room_number"))
    return fx.rooms().join(wanted, "room_number", "left_semi").select("room_id", "hotel_id", "room_number")


@register("filter_like_ci", f"""
SELECT hotel_id, city, country FROM hotels
WHERE lower(city) LIKE '%{CITY_COUNTRY['city']}%' AND lower(country) LIKE '%{LIKE_COUNTRY}%'
""")
def filter_like_ci(fx):
    return (fx.hotels().where(like_ci("city", CITY_COUNTRY["city"]) & like_ci("country", LIKE_COUNTRY))
            .select("hotel_id", "city", "country"))


@register("filter_contains_ci", f"""
SELECT hotel_id, city FROM hotels WHERE contains(lower(city), '{CONTAINS_CITY}')
""")
def filter_contains_ci(fx):
    return fx.hotels().where(contains_ci("city", CONTAINS_CITY)).select("hotel_id", "city")


@register("filter_min_rating", f"""
WITH {AGG_CTES}
SELECT h.hotel_id, {AVG_RATING} AS average_rating
FROM hotels h LEFT JOIN rv ON rv.hotel_id = h.hotel_id
WHERE {AVG_RATING} >= {MIN_RATING}
""")
def filter_min_rating(fx):
    rs = agg.review_summary(fx.reviews())
    return (fx.hotels().select("hotel_id").join(rs, "hotel_id", "left")
            .where(min_rating("avg_rating", MIN_RATING))
            .select("hotel_id", F.coalesce("avg_rating", F.lit(0)).cast("double").alias("average_rating")))


@register("filter_price_rating_range", f"""
WITH {AGG_CTES}
SELECT h.hotel_id, {AVG_PRICE} AS average_price_per_night, {AVG_RATING} AS average_rating
FROM hotels h LEFT JOIN rs ON rs.hotel_id = h.hotel_id LEFT JOIN rv ON rv.hotel_id = h.hotel_id
WHERE {AVG_PRICE} BETWEEN {PRICE_RATING['min_price']} AND {PRICE_RATING['max_price']}
  AND {AVG_RATING} >= {PRICE_RATING['min_rating']}
""")
def filter_price_rating_range(fx):
    p = PRICE_RATING
    cards = HotelAnswers(fx)._enrich(fx.hotels().select("id", "hotel_id", "created_at"),
                                      bookings=False, price=True, restrict=False)
    return (cards.where(HotelAnswers._price_rating_pred(p["min_price"], p["max_price"], p["min_rating"]))
            .select("hotel_id", F.col("average_price_per_night").cast("double").alias("average_price_per_night"),
                    F.col("average_rating").cast("double").alias("average_rating")))


@register("filter_bool_flag", "SELECT room_id, hotel_id, room_number FROM rooms WHERE is_available")
def filter_bool_flag(fx):
    return fx.rooms().where(is_true("is_available")).select("room_id", "hotel_id", "room_number")


@register("filter_status_ne", """
SELECT booking_id, booking_status FROM bookings WHERE booking_status IS DISTINCT FROM 'Cancelled'
""")
def filter_status_ne(fx):
    return fx.bookings().where(status_not("booking_status")).select("booking_id", "booking_status")
