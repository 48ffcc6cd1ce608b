"""Registered keys: the five read answers, intended and literal."""

from __future__ import annotations

from innkeep.oracle.sqlparts import AGG_CTES, card_joins, card_select, pages
from innkeep.plans.directory import HotelAnswers
from innkeep.registry import register

# Fixed request parameters of the registered answers.
DIRECTORY_PAGE = 1
ADMIN = dict(city="nation_1", country="a", ratings=2.5,
             sort_availability="high to low", bookings_count="low to high", page_no=1)
CITY_COUNTRY = dict(city="nation_1", country="", page_no=1)
PRICE_RATING = dict(min_price=945.0, max_price=955.0, min_rating=2.9, page_no=1)
HISTORY = dict(customer_id="CUST00606", page_no=1)

_TOTALS_HOTELS = ("(SELECT COUNT(*) FROM {t}) AS total_hotels, "
                  + pages("(SELECT COUNT(*) FROM {t})") + " AS total_pages, 1 AS current_page")


def _dir_sql(literal: bool) -> str:
    return f"""
WITH {AGG_CTES},
pg AS (SELECT *, ROW_NUMBER() OVER (ORDER BY created_at DESC, id) AS page_pos
       FROM hotels ORDER BY created_at DESC, id LIMIT 10 OFFSET 0)
SELECT {card_select('pg', literal=literal)}, pg.page_pos, {_TOTALS_HOTELS.format(t='hotels')}
FROM pg {card_joins('pg', literal=literal)}
"""


@register("hotel_directory", _dir_sql(False))
def hotel_directory(fx):
    return HotelAnswers(fx).hotel_directory(DIRECTORY_PAGE)


@register("hotel_directory_literal", _dir_sql(True))
def hotel_directory_literal(fx):
    return HotelAnswers(fx).hotel_directory(DIRECTORY_PAGE, mode="literal")


_CARD_OUT = ("hotel_id, hotel_name, city, country, total_rooms, created_at, total_rooms_available, "
             "average_rating, total_reviews, n_rooms, n_services, total_bookings, n_bookings")


def _admin_sql(literal: bool) -> str:
    a = ADMIN
    where = f"contains(lower(city), '{a['city']}') AND contains(lower(country), '{a['country']}')" \
            f" AND average_rating >= {a['ratings']}"
    if literal:
        src = ("pg0 AS (SELECT * FROM hotels ORDER BY created_at DESC, id LIMIT 10 OFFSET 0),\n"
               f"cards AS (SELECT pg0.id, pg0.created_at AS _created, {card_select('pg0', literal=True)}"
               f" FROM pg0 {card_joins('pg0', literal=True)})")
        order = "total_rooms_available DESC, _created DESC, id"
    else:
        src = (f"cards AS (SELECT h.id, h.created_at AS _created, {card_select('h')}"
               f" FROM hotels h {card_joins('h')})")
        order = "total_bookings ASC, total_rooms_available DESC, _created DESC, id"
    return f"""
WITH {AGG_CTES},
{src},
f AS (SELECT * FROM cards WHERE {where}),
pg AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS page_pos FROM f ORDER BY page_pos LIMIT 10)
SELECT {_CARD_OUT}, page_pos, {_TOTALS_HOTELS.format(t='f')} FROM pg
"""


@register("hotel_admin_search", _admin_sql(False))
def hotel_admin_search(fx):
    return HotelAnswers(fx).hotel_admin_search(**ADMIN)


@register("hotel_admin_search_literal", _admin_sql(True))
def hotel_admin_search_literal(fx):
    return HotelAnswers(fx).hotel_admin_search(**ADMIN, mode="literal")


@register("hotel_search_city_country", f"""
WITH {AGG_CTES},
m AS (SELECT * FROM hotels WHERE lower(city) LIKE '%{CITY_COUNTRY['city']}%'
                             AND lower(country) LIKE '%{CITY_COUNTRY['country']}%'),
pg AS (SELECT *, ROW_NUMBER() OVER (ORDER BY hotel_id, id) AS page_pos
       FROM m ORDER BY hotel_id, id LIMIT 10 OFFSET 0)
SELECT {card_select('pg', bookings=False, price=True, created=False)}, pg.page_pos,
       {_TOTALS_HOTELS.format(t='m')}
FROM pg {card_joins('pg', bookings=False)}
""")
def hotel_search_city_country(fx):
    return HotelAnswers(fx).hotel_search_city_country(**CITY_COUNTRY)


_PRICE_OUT = ("hotel_id, hotel_name, city, country, total_rooms, total_rooms_available, average_rating, "
              "total_reviews, n_rooms, n_services, average_price_per_night")


def _price_sql(literal: bool) -> str:
    p = PRICE_RATING
    pred = (f"average_price_per_night BETWEEN {p['min_price']} AND {p['max_price']}"
            f" AND average_rating >= {p['min_rating']}")
    base = "(SELECT * FROM hotels h WHERE EXISTS (SELECT 1 FROM rooms r WHERE r.hotel_id = h.hotel_id))"
    if literal:
        base = f"(SELECT * FROM {base} x ORDER BY created_at DESC, id LIMIT 10 OFFSET 0)"
    return f"""
WITH {AGG_CTES},
wr AS {base},
cards AS (SELECT wr.id, wr.created_at AS _created,
                 {card_select('wr', bookings=False, price=True, created=False)}
          FROM wr {card_joins('wr', bookings=False)}),
f AS (SELECT * FROM cards WHERE {pred}),
pg AS (SELECT *, ROW_NUMBER() OVER (ORDER BY _created DESC, id) AS page_pos FROM f ORDER BY page_pos LIMIT 10)
SELECT {_PRICE_OUT}, page_pos, {_TOTALS_HOTELS.format(t='f')} FROM pg
"""


@register("hotel_search_price_rating", _price_sql(False))
def hotel_search_price_rating(fx):
    return HotelAnswers(fx).hotel_search_price_rating(**PRICE_RATING)


@register("hotel_search_price_rating_literal", _price_sql(True))
def hotel_search_price_rating_literal(fx):
    return HotelAnswers(fx).hotel_search_price_rating(**PRICE_RATING, mode="literal")


@register("booking_history", f"""
WITH mine AS (SELECT * FROM bookings WHERE customer_id = '{HISTORY['customer_id']}'),
listed AS (SELECT m.*, h.hotel_name FROM mine m JOIN hotels h ON m.hotel_id = h.hotel_id),
pg AS (SELECT *, ROW_NUMBER() OVER (ORDER BY created_at DESC, id) AS page_pos
       FROM listed ORDER BY created_at DESC, id LIMIT 10 OFFSET 0),
br AS (SELECT booking_id, COUNT(*) AS n_rooms, SUM(room_amount) AS rooms_amount
       FROM booking_rooms GROUP BY booking_id),
bc AS (SELECT booking_id,
              arg_max(cancel_reason, CAST(regexp_replace(booking_cancel_id, '[^0-9]', '', 'g') AS BIGINT))
                AS cancel_reason
       FROM bookings_cancelled GROUP BY booking_id)
SELECT pg.hotel_name AS hotelName, pg.booking_id, pg.hotel_id, bc.cancel_reason,
       CAST(pg.total_amount AS DOUBLE) AS total_amount, pg.booking_status,
       c.full_name AS customer_name, CAST(COALESCE(br.n_rooms, 0) AS BIGINT) AS n_rooms,
       CAST(br.rooms_amount AS DOUBLE) AS rooms_amount, pg.page_pos,
       (SELECT COUNT(DISTINCT booking_id) FROM mine) AS total_bookings,
       (SELECT COUNT(*) FROM listed) AS total_listed,
       {pages('(SELECT COUNT(DISTINCT booking_id) FROM mine)')} AS total_pages, 1 AS current_page
FROM pg LEFT JOIN customers c ON pg.customer_id = c.customer_id
        LEFT JOIN br ON br.booking_id = pg.booking_id
        LEFT JOIN bc ON bc.booking_id = pg.booking_id
""")
def booking_history(fx):
    return HotelAnswers(fx).booking_history(**HISTORY)


@register("booking_history_literal", f"""
WITH mine AS (SELECT * FROM bookings WHERE customer_id = '{HISTORY['customer_id']}'),
r AS (SELECT b.*, c.full_name AS customer_name, br.booking_room_id, h.hotel_name, bc.booking_cancel_id,
             bc.cancel_reason
      FROM mine b LEFT JOIN customers c ON b.customer_id = c.customer_id
      LEFT JOIN booking_rooms br ON b.booking_id = br.booking_id
      JOIN hotels h ON b.hotel_id = h.hotel_id
      LEFT JOIN bookings_cancelled bc ON b.booking_id = bc.booking_id),
pg AS (SELECT *, ROW_NUMBER() OVER (ORDER BY created_at DESC, id, booking_room_id NULLS FIRST,
                                      booking_cancel_id NULLS FIRST) AS row_pos
       FROM r ORDER BY row_pos LIMIT 10 OFFSET 0)
SELECT arg_min(hotel_name, row_pos) AS hotelName, booking_id, arg_min(hotel_id, row_pos) AS hotel_id,
       arg_min(cancel_reason, row_pos) AS cancel_reason,
       CAST(arg_min(total_amount, row_pos) AS DOUBLE) AS total_amount,
       arg_min(booking_status, row_pos) AS booking_status, arg_min(customer_name, row_pos) AS customer_name,
       COUNT(*) AS n_room_entries, MIN(row_pos) AS page_pos,
       (SELECT COUNT(DISTINCT booking_id) FROM mine) AS total_bookings,
       {pages('(SELECT COUNT(DISTINCT booking_id) FROM mine)')} AS total_pages, 1 AS current_page
FROM pg GROUP BY booking_id
""")
def booking_history_literal(fx):
    return HotelAnswers(fx).booking_history_literal(**HISTORY)
