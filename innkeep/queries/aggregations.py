"""Registered keys: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from innkeep.functions.ids import digits_number, unsigned_suffix
from innkeep.operators import aggregates as agg
from innkeep.operators.filters import like_ci
from innkeep.oracle.sqlparts import AGG_CTES, AVG_PRICE, AVG_PRICE_RAW, AVG_RATING, digits, round2_avg_int
from innkeep.oracle.sqlparts import unsigned_suffix as sql_suffix
from innkeep.plans.directory import HotelAnswers
from innkeep.queries.composites import CITY_COUNTRY, PRICE_RATING
from innkeep.queries.scans import LIKE_COUNTRY
from innkeep.registry import register


@register("agg_review_summary", f"""
SELECT hotel_id, {round2_avg_int('SUM(rating)', 'COUNT(*)')} AS avg_rating, COUNT(*) AS total_reviews
FROM reviews GROUP BY hotel_id
""")
def agg_review_summary(fx):
    return (agg.review_summary(fx.reviews())
            .select("hotel_id", F.col("avg_rating").cast("double").alias("avg_rating"), "total_reviews"))


@register("agg_avg_price", f"""
WITH {AGG_CTES}
SELECT hotel_id, {AVG_PRICE_RAW} AS avg_price_per_night FROM rs
""")
def agg_avg_price(fx):
    return (agg.avg_price(fx.rooms())
            .select("hotel_id", F.col("avg_price_per_night").cast("double").alias("avg_price_per_night")))


@register("agg_available_rooms", f"""
WITH {AGG_CTES}
SELECT h.hotel_id, CAST(COALESCE(rs.avail, 0) AS BIGINT) AS total_rooms_available
FROM hotels h LEFT JOIN rs ON rs.hotel_id = h.hotel_id
""")
def agg_available_rooms(fx):
    return (fx.hotels().select("hotel_id")
            .join(agg.available_rooms(fx.rooms()), "hotel_id", "left")
            .select("hotel_id", F.coalesce("total_rooms_available", F.lit(0)).cast("long")
                    .alias("total_rooms_available")))


@register("agg_booking_count", f"""
WITH {AGG_CTES}
SELECT h.hotel_id, CAST(COALESCE(bk.total_bookings, 0) AS BIGINT) AS total_bookings
FROM hotels h LEFT JOIN bk ON bk.hotel_id = h.hotel_id
""")
def agg_booking_count(fx):
    """Intended: distinct non-cancelled bookings per hotel."""
    return (fx.hotels().select("hotel_id").join(agg.booking_counts(fx.bookings()), "hotel_id", "left")
            .select("hotel_id", F.coalesce("total_bookings", F.lit(0)).cast("long").alias("total_bookings")))


@register("agg_booking_count_literal", f"""
WITH {AGG_CTES}
SELECT h.hotel_id, CAST(COALESCE(bkl.total_bookings, 0) AS BIGINT) AS total_bookings
FROM hotels h LEFT JOIN bkl ON bkl.hotel_id = h.hotel_id
""")
def agg_booking_count_literal(fx):
    """Literal (Q4): joined booking x room x cancel rows that are not Cancelled."""
    counts = agg.booking_counts_literal(fx.bookings(), fx.booking_rooms(), fx.bookings_cancelled())
    return (fx.hotels().select("hotel_id").join(counts, "hotel_id", "left")
            .select("hotel_id", F.coalesce("total_bookings", F.lit(0)).cast("long").alias("total_bookings")))


@register("agg_total_hotels", "SELECT COUNT(*) AS total_hotels FROM hotels")
def agg_total_hotels(fx):
    return fx.hotels().agg(F.count(F.lit(1)).alias("total_hotels"))


@register("agg_total_filtered", f"""
SELECT COUNT(*) AS total_hotels FROM hotels
WHERE lower(city) LIKE '%{CITY_COUNTRY['city']}%' AND lower(country) LIKE '%{LIKE_COUNTRY}%'
""")
def agg_total_filtered(fx):
    return (fx.hotels().where(like_ci("city", CITY_COUNTRY["city"]) & like_ci("country", LIKE_COUNTRY))
            .agg(F.count(F.lit(1)).alias("total_hotels")))


@register("agg_count_distinct", """
SELECT customer_id, COUNT(DISTINCT booking_id) AS total_bookings FROM bookings GROUP BY customer_id
""")
def agg_count_distinct(fx):
    """COUNT(DISTINCT booking_id) per customer (the history total, for every
    customer at once)."""
    return fx.bookings().groupBy("customer_id").agg(F.count_distinct("booking_id").alias("total_bookings"))


@register("agg_nest_bookings", """
WITH br AS (SELECT booking_id, COUNT(*) AS n_rooms, SUM(room_amount) AS rooms_amount
            FROM booking_rooms GROUP BY booking_id),
bc AS (SELECT booking_id,
              arg_max(cancel_reason, CAST(regexp_replace(booking_cancel_id, '[^0-9]', '', 'g') AS BIGINT))
                AS cancel_reason,
              COUNT(*) AS cancel_rows
       FROM bookings_cancelled GROUP BY booking_id)
SELECT b.hotel_id, b.booking_id, c.full_name AS customer_name, b.booking_status AS status,
       CAST(b.total_amount AS DOUBLE) AS total_amount, bc.cancel_reason,
       CAST(COALESCE(br.n_rooms, 0) AS BIGINT) AS n_rooms,
       CAST(COALESCE(br.n_rooms, 1) * COALESCE(bc.cancel_rows, 1) AS BIGINT) AS n_room_entries_literal,
       CAST(br.rooms_amount AS DOUBLE) AS rooms_amount
FROM bookings b LEFT JOIN customers c ON b.customer_id = c.customer_id
LEFT JOIN br ON br.booking_id = b.booking_id LEFT JOIN bc ON bc.booking_id = b.booking_id
""")
def agg_nest_bookings(fx):
    """Two-level nest, one row per booking (the booking entry of a hotel):
    its scalars, the latest cancel reason, the room count (intended: empty
    list when there are no rooms) and the literal entry count (Q11: cancel
    rows repeat the rooms; Q12: a room-less booking still gets one entry).
    Rooms are pre-aggregated per booking before the join, so no booking's
    rooms are collected in one place."""
    br = fx.booking_rooms().groupBy("booking_id").agg(
        F.count(F.lit(1)).alias("n_rooms"), F.sum("room_amount").alias("rooms_amount"))
    bc = agg.latest_cancel(fx.bookings_cancelled())
    cust = fx.customers().select("customer_id", F.col("full_name").alias("customer_name"))
    j = (fx.bookings().join(cust, "customer_id", "left").join(br, "booking_id", "left")
         .join(bc, "booking_id", "left"))
    return j.select(
        "hotel_id", "booking_id", "customer_name", F.col("booking_status").alias("status"),
        F.col("total_amount").cast("double").alias("total_amount"), "cancel_reason",
        F.coalesce("n_rooms", F.lit(0)).cast("long").alias("n_rooms"),
        (F.coalesce("n_rooms", F.lit(1)) * F.coalesce("cancel_rows", F.lit(1))).cast("long")
        .alias("n_room_entries_literal"),
        F.col("rooms_amount").cast("double").alias("rooms_amount"))


@register("agg_distinct_rows", """
SELECT DISTINCT h.hotel_id, h.hotel_name, h.city, h.country, h.total_rooms
FROM hotels h INNER JOIN rooms r ON h.hotel_id = r.hotel_id
""")
def agg_distinct_rows(fx):
    """SELECT DISTINCT over the hotel x room join.  The rooms side is first
    reduced to distinct hotel keys (partial aggregate), so the join emits one
    row per hotel and the DISTINCT has nothing left to remove at scale."""
    keys = fx.rooms().select("hotel_id").distinct()
    return (fx.hotels().join(keys, "hotel_id")
            .select("hotel_id", "hotel_name", "city", "country", "total_rooms").distinct())


# Id prefixes and the 1-based position where the numeric part starts, as the
# reference orders its tables for "the last id" (fixed values).
LAST_ID_RULES = [
    ("hotels", "hotel_id", None),
    ("rooms", "room_id", None),
    ("services", "service_id", None),
    ("bookings", "booking_id", 5),
    ("booking_rooms", "booking_room_id", 3),
    ("bookings_cancelled", "booking_cancel_id", 11),
    ("reviews", "review_id", 4),
    ("maintenance", "maintenance_id", 9),
]


def _suffix_sql(col, start):
    return digits(col) if start is None else sql_suffix(col, start)


def _suffix(col, start):
    return digits_number(F.col(col)) if start is None else unsigned_suffix(F.col(col), start)


@register("agg_last_id", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, MAX({_suffix_sql(c, s)}) AS last_number FROM {t}"
    for t, c, s in LAST_ID_RULES))
def agg_last_id(fx):
    """Highest numeric id suffix per table (what the next id continues from)."""
    parts = [fx.table(t).agg(F.max(_suffix(c, s)).alias("last_number"))
             .select(F.lit(t).alias("table_name"), "last_number") for t, c, s in LAST_ID_RULES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("agg_group_duplicates", """
SELECT request_seq, 'room_number' AS kind, room_number AS value, COUNT(*) AS copies
FROM hotel_request_rooms GROUP BY request_seq, room_number HAVING COUNT(*) > 1
UNION ALL
SELECT request_seq, 'service_name' AS kind, lower(trim(service_name)) AS value, COUNT(*) AS copies
FROM hotel_request_services WHERE trim(service_name) <> ''
GROUP BY request_seq, lower(trim(service_name)) HAVING COUNT(*) > 1
""")
def agg_group_duplicates(fx):
    """Values repeated inside one request: room numbers exactly, service
    names ignoring case (blank names are skipped, as the reference does)."""
    from innkeep.functions.text import js_trim
    rooms = (fx.hotel_request_rooms().groupBy("request_seq", F.col("room_number").alias("value"))
             .agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
             .select("request_seq", F.lit("room_number").alias("kind"), "value", "copies"))
    name = F.lower(js_trim("service_name"))
    services = (fx.hotel_request_services().where(js_trim("service_name") != "")
                .groupBy("request_seq", name.alias("value"))
                .agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
                .select("request_seq", F.lit("service_name").alias("kind"), "value", "copies"))
    return rooms.unionByName(services)


@register("agg_having_total", f"""
WITH rs AS (SELECT hotel_id, SUM(CAST(price_per_night * 100 AS BIGINT)) AS price_cents,
                   COUNT(price_per_night) AS priced FROM rooms GROUP BY hotel_id),
rv AS (SELECT hotel_id, SUM(rating) AS rsum, COUNT(*) AS rcnt FROM reviews GROUP BY hotel_id),
g AS (SELECT h.hotel_id,
             {AVG_PRICE} AS p,
             {AVG_RATING} AS r
      FROM hotels h JOIN rs ON rs.hotel_id = h.hotel_id LEFT JOIN rv ON rv.hotel_id = h.hotel_id)
SELECT COUNT(*) AS total_hotels FROM g
WHERE p BETWEEN {PRICE_RATING['min_price']} AND {PRICE_RATING['max_price']} AND r >= {PRICE_RATING['min_rating']}
""")
def agg_having_total(fx):
    """GROUP BY hotel .. HAVING on average price and rating (the intended
    total of the price/rating search).  Rooms and reviews are aggregated
    separately before joining, so the two child tables never multiply."""
    p = PRICE_RATING
    with_rooms = fx.hotels().select("id", "hotel_id", "created_at").join(
        fx.rooms().select("hotel_id").distinct(), "hotel_id", "left_semi")
    cards = HotelAnswers(fx)._enrich(with_rooms, bookings=False, price=True, restrict=False)
    return (cards.where(HotelAnswers._price_rating_pred(p["min_price"], p["max_price"], p["min_rating"]))
            .agg(F.count(F.lit(1)).alias("total_hotels")))
