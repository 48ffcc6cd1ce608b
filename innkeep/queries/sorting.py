"""Registered keys: sorts, limits and paging.

Full orderings are returned as (key, rank) rows computed by the distributed
``global_rank``; pages use the top-k plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from innkeep.functions.ids import digits_number, unsigned_suffix
from innkeep.operators.filters import like_ci
from innkeep.operators.ranking import global_rank, page, page_count, rank_within_groups
from innkeep.oracle.sqlparts import AGG_CTES, AVG_RATING, pages
from innkeep.oracle.sqlparts import digits as sql_digits
from innkeep.oracle.sqlparts import unsigned_suffix as sql_suffix
from innkeep.plans.directory import HotelAnswers, newest_first, newest_hotels
from innkeep.queries.aggregations import LAST_ID_RULES
from innkeep.queries.composites import CITY_COUNTRY
from innkeep.registry import register

LIMIT_PAGE = 2


@register("sort_newest", """
SELECT hotel_id, ROW_NUMBER() OVER (ORDER BY created_at DESC, id) AS rank FROM hotels
""")
def sort_newest(fx):
    return global_rank(fx.hotels(), newest_first()).select("hotel_id", "rank")


@register("sort_price_asc", """
SELECT hotel_id, room_number, CAST(price_per_night AS DOUBLE) AS price_per_night,
       ROW_NUMBER() OVER (PARTITION BY hotel_id ORDER BY price_per_night ASC NULLS FIRST, id) AS pos
FROM rooms
""")
def sort_price_asc(fx):
    """Rooms of each hotel by price, cheapest first, NULL prices first (the
    order of the nested rooms array of the price search)."""
    r = fx.rooms().select("id", "hotel_id", "room_number", "price_per_night")
    return (rank_within_groups(r, ["hotel_id"], [F.col("price_per_night").asc_nulls_first(), F.col("id")])
            .select("hotel_id", "room_number", F.col("price_per_night").cast("double").alias("price_per_night"),
                    "pos"))


def _cards(fx):
    return HotelAnswers(fx)._enrich(fx.hotels().select("id", "hotel_id", "created_at"),
                                     bookings=True, price=False, restrict=False)


_CARDS_SQL = f"""
WITH {AGG_CTES},
c AS (SELECT h.id, h.hotel_id, h.created_at, COALESCE(rs.avail, 0) AS total_rooms_available,
             {AVG_RATING} AS average_rating, COALESCE(bk.total_bookings, 0) AS total_bookings
      FROM hotels h LEFT JOIN rs ON rs.hotel_id = h.hotel_id LEFT JOIN rv ON rv.hotel_id = h.hotel_id
                    LEFT JOIN bk ON bk.hotel_id = h.hotel_id)
"""


@register("sort_availability", _CARDS_SQL + """
SELECT hotel_id, CAST(total_rooms_available AS BIGINT) AS total_rooms_available,
       ROW_NUMBER() OVER (ORDER BY total_rooms_available DESC, created_at DESC, id) AS rank FROM c
""")
def sort_availability(fx):
    """High to low availability; stable over newest-first."""
    order = [F.col("total_rooms_available").desc(), *newest_first()]
    return global_rank(_cards(fx), order).select("hotel_id", "total_rooms_available", "rank")


@register("sort_booking_count", _CARDS_SQL + """
SELECT hotel_id, CAST(total_bookings AS BIGINT) AS total_bookings,
       ROW_NUMBER() OVER (ORDER BY total_bookings ASC, created_at DESC, id) AS rank FROM c
""")
def sort_booking_count(fx):
    """Low to high booking count (the intended effect of quirk Q5's sort)."""
    order = [F.col("total_bookings").asc(), *newest_first()]
    return global_rank(_cards(fx), order).select("hotel_id", "total_bookings", "rank")


@register("sort_rating", _CARDS_SQL + """
SELECT hotel_id, average_rating,
       ROW_NUMBER() OVER (ORDER BY average_rating DESC, created_at DESC, id) AS rank FROM c
""")
def sort_rating(fx):
    """High to low average rating (the option of the commented-out search)."""
    order = [F.col("average_rating").desc(), *newest_first()]
    return (global_rank(_cards(fx), order)
            .select("hotel_id", F.col("average_rating").cast("double").alias("average_rating"), "rank"))


@register("limit_offset_page", f"""
SELECT hotel_id, ROW_NUMBER() OVER (ORDER BY created_at DESC, id) - {(LIMIT_PAGE - 1) * 10} AS page_pos
FROM hotels ORDER BY created_at DESC, id LIMIT 10 OFFSET {(LIMIT_PAGE - 1) * 10}
""")
def limit_offset_page(fx):
    """LIMIT 10 OFFSET (page-1)*10 in newest-first order."""
    return newest_hotels(fx, LIMIT_PAGE).select("hotel_id", "page_pos")


@register("slice_page", f"""
WITH m AS (SELECT * FROM hotels WHERE lower(city) LIKE '%{CITY_COUNTRY['city']}%')
SELECT hotel_id, ROW_NUMBER() OVER (ORDER BY created_at DESC, id) - {(LIMIT_PAGE - 1) * 10} AS page_pos
FROM m ORDER BY created_at DESC, id LIMIT 10 OFFSET {(LIMIT_PAGE - 1) * 10}
""")
def slice_page(fx):
    """A page of the filtered list (filter first, then slice once)."""
    m = fx.hotels().where(like_ci("city", CITY_COUNTRY["city"]))
    return page(m, newest_first(), LIMIT_PAGE).select("hotel_id", "page_pos")


def _suffix_sql(col, start):
    return sql_digits(col) if start is None else sql_suffix(col, start)


BY_ROW_ID = ("hotels", "rooms")   # read by the surrogate id, not by the number in the key


@register("top1_last_row", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, arg_max({c}, "
    + ("id)" if t in BY_ROW_ID else f"struct_pack(k := {_suffix_sql(c, s)}, d := {sql_digits(c)}))") +
    f" AS last_id FROM {t}"
    for t, c, s in LAST_ID_RULES))
def top1_last_row(fx):
    """The row the reference reads as "last": ORDER BY id (hotels, rooms) or
    numeric suffix DESC LIMIT 1, as ``max_by`` (a partial aggregate, no sort).  Ties on the
    suffix ('BR7-1', 'BR7-2') are left open by the reference; we take the one
    with the most digits-value."""
    parts = []
    for t, c, s in LAST_ID_RULES:
        k = digits_number(F.col(c)) if s is None else unsigned_suffix(F.col(c), s)
        order = F.col("id") if t in BY_ROW_ID else F.struct(k, digits_number(F.col(c)))
        parts.append(fx.table(t).agg(F.max_by(c, order).alias("last_id"))
                     .select(F.lit(t).alias("table_name"), "last_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("page_summary", f"""
SELECT 'all' AS scope, COUNT(*) AS total, {pages('COUNT(*)')} AS total_pages FROM hotels
UNION ALL
SELECT 'city' AS scope, COUNT(*) AS total, {pages('COUNT(*)')} AS total_pages FROM hotels
WHERE lower(city) LIKE '%{CITY_COUNTRY['city']}%'
""")
def page_summary(fx):
    """ceil(total / 10) for the whole directory and for a filtered list."""
    h = fx.hotels()
    a = h.agg(F.count(F.lit(1)).alias("total")).select(F.lit("all").alias("scope"), "total")
    c = (h.where(like_ci("city", CITY_COUNTRY["city"])).agg(F.count(F.lit(1)).alias("total"))
         .select(F.lit("city").alias("scope"), "total"))
    return a.unionByName(c).withColumn("total_pages", page_count(F.col("total")))
