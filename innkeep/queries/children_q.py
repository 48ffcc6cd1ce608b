"""Registered keys: the children of the read answers as rows (SURVEY 2.0,
2.3 ``join_app_nest``, 2.4 ``agg_nest_bookings``) and the documents written
from them (2.1 ``write_documents``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from innkeep.plans.children import PageChildren
from innkeep.plans.directory import HotelAnswers
from innkeep.plans.fragments import FRAGMENT_BYTES, SECTIONS, document_entries, fragment_entries
from innkeep.queries import composites as C
from innkeep.registry import ORACLE_RAW, register


def _out(df):
    """Dates as text and decimals as doubles, as in the other keys."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("string" if kinds[c] == "date" else "double" if kinds[c].startswith("decimal") else kinds[c]).alias(c)
                       for c in df.columns])


#: pages that need no enrichment, from the page's own order
_PLAIN_PAGES = {
    "hotel_directory": "(SELECT ROW_NUMBER() OVER (ORDER BY created_at DESC, id) AS page_pos, hotel_id FROM hotels ORDER BY created_at DESC, id LIMIT 10)",
    "hotel_search_city_country": "(SELECT ROW_NUMBER() OVER (ORDER BY hotel_id, id) AS page_pos, hotel_id FROM hotels "
                                 f"WHERE lower(city) LIKE '%{C.CITY_COUNTRY['city']}%' AND lower(country) LIKE '%{C.CITY_COUNTRY['country']}%' "
                                 "ORDER BY hotel_id, id LIMIT 10)",
}


def _page_sql(answer: str) -> str:
    if answer in _PLAIN_PAGES:
        return _PLAIN_PAGES[answer]
    return f"(SELECT page_pos, hotel_id FROM ({ORACLE_RAW[answer].strip()}) answer)"


def _rooms(pg: str, by_price: bool) -> str:
    order = "r.price_per_night ASC NULLS FIRST, r.id" if by_price else "r.id"
    return f"""
SELECT pg.page_pos, r.hotel_id, ROW_NUMBER() OVER (PARTITION BY r.hotel_id ORDER BY {order}) AS pos, r.room_number, r.room_type,
       CAST(r.price_per_night AS DOUBLE) AS price_per_night, r.is_available
FROM rooms r JOIN {pg} pg ON pg.hotel_id = r.hotel_id"""


def _services(pg: str) -> str:
    return f"""
SELECT pg.page_pos, s.hotel_id, ROW_NUMBER() OVER (PARTITION BY s.hotel_id ORDER BY s.service_id) AS pos, s.service_id, s.service_name,
       CAST(s.service_charge AS DOUBLE) AS service_charge
FROM services s JOIN {pg} pg ON pg.hotel_id = s.hotel_id"""


def _reviews(pg: str) -> str:
    return f"""
SELECT pg.page_pos, r.hotel_id, ROW_NUMBER() OVER (PARTITION BY r.hotel_id ORDER BY r.id) AS pos, c.full_name AS customer_name,
       r.rating, r.comment, CAST(r.review_date AS VARCHAR) AS review_date
FROM reviews r JOIN {pg} pg ON pg.hotel_id = r.hotel_id LEFT JOIN customers c ON c.customer_id = r.customer_id"""


_BOOKING_POS = "ROW_NUMBER() OVER (PARTITION BY b.hotel_id ORDER BY b.created_at DESC, b.id)"
_CANCEL_NO = "CAST(regexp_replace(booking_cancel_id, '[^0-9]', '', 'g') AS BIGINT)"


def _bookings(pg: str) -> str:
    return f"""
SELECT pg.page_pos, b.hotel_id, {_BOOKING_POS} AS pos, b.booking_id, c.full_name AS customer_name, b.booking_status AS status,
       CAST(b.total_amount AS DOUBLE) AS total_amount, bc.cancel_reason, COALESCE(br.n, 0) AS n_rooms
FROM bookings b JOIN {pg} pg ON pg.hotel_id = b.hotel_id LEFT JOIN customers c ON c.customer_id = b.customer_id
LEFT JOIN (SELECT booking_id, COUNT(*) AS n FROM booking_rooms GROUP BY booking_id) br ON br.booking_id = b.booking_id
LEFT JOIN (SELECT booking_id, arg_max(cancel_reason, {_CANCEL_NO}) AS cancel_reason FROM bookings_cancelled GROUP BY booking_id) bc
  ON bc.booking_id = b.booking_id"""


def _placed_bookings(pg: str) -> str:
    return f"(SELECT pg.page_pos, b.hotel_id, {_BOOKING_POS} AS booking_pos, b.booking_id FROM bookings b JOIN {pg} pg ON pg.hotel_id = b.hotel_id)"


def _booking_rooms(b: str, lead: str) -> str:
    return f"""
SELECT {lead}, ROW_NUMBER() OVER (PARTITION BY r.booking_id ORDER BY r.booking_room_id) AS pos, r.room_number,
       CAST(r.check_in AS VARCHAR) AS check_in, CAST(r.check_out AS VARCHAR) AS check_out, CAST(r.room_amount AS DOUBLE) AS room_amount
FROM booking_rooms r JOIN {b} b ON b.booking_id = r.booking_id"""


def _booking_cancels(b: str, lead: str) -> str:
    return f"""
SELECT {lead}, k.pos, k.booking_cancel_id, k.cancel_reason
FROM (SELECT booking_id, booking_cancel_id, cancel_reason,
             ROW_NUMBER() OVER (PARTITION BY booking_id ORDER BY {_CANCEL_NO}, booking_cancel_id) AS pos FROM bookings_cancelled) k
JOIN {b} b ON b.booking_id = k.booking_id"""


_LEAD = "b.page_pos, b.hotel_id, b.booking_pos, b.booking_id"

# the page of each answer, whether its rooms are sorted by price, and whether it lists bookings
ANSWERS = {
    "hotel_directory": (lambda a: a.directory_page(C.DIRECTORY_PAGE), False, True),
    "hotel_admin_search": (lambda a: a.hotel_admin_search(**C.ADMIN), False, True),
    "hotel_search_city_country": (lambda a: a.city_country_page(**C.CITY_COUNTRY), False, False),
    "hotel_search_price_rating": (lambda a: a.hotel_search_price_rating(**C.PRICE_RATING), True, False),
}


def _register(answer: str, kind: str, page, by_price: bool, sql: str) -> None:
    def children(fx):
        return _out(getattr(PageChildren(fx, page(HotelAnswers(fx)), by_price), kind)())
    children.__name__ = f"{answer}_{kind}"
    children.__doc__ = f"The {kind} of each entry on the page of ``{answer}``, as rows."
    register(children.__name__, sql)(children)


for _answer, (_page, _by_price, _lists) in ANSWERS.items():
    _pg = _page_sql(_answer)
    _found = {"rooms": _rooms(_pg, _by_price), "services": _services(_pg), "reviews": _reviews(_pg)}
    if _lists:
        _b = _placed_bookings(_pg)
        _found |= {"bookings": _bookings(_pg), "booking_rooms": _booking_rooms(_b, _LEAD), "booking_cancels": _booking_cancels(_b, _LEAD)}
    for _kind, _sql in _found.items():
        _register(_answer, _kind, _page, _by_price, _sql)

_HISTORY_PAGE = f"(SELECT page_pos, booking_id FROM ({ORACLE_RAW['booking_history'].strip()}) answer)"


@register("booking_history_rooms", _booking_rooms(_HISTORY_PAGE, "b.page_pos, b.booking_id"))
def booking_history_rooms(fx):
    """The rooms of each booking on the history page."""
    return _out(PageChildren(fx, HotelAnswers(fx).history_bookings(**C.HISTORY)).booking_rooms())


@register("booking_history_cancels", _booking_cancels(_HISTORY_PAGE, "b.page_pos, b.booking_id"))
def booking_history_cancels(fx):
    """All cancel reasons of each booking on the history page."""
    return _out(PageChildren(fx, HotelAnswers(fx).history_bookings(**C.HISTORY)).booking_cancels())


# -- documents ------------------------------------------------------------------
def _json(fields: dict[str, str]) -> str:
    """A JSON object of SQL expressions without its NULL fields; strings are
    given as expressions that quote them."""
    parts = ", ".join(f"CASE WHEN {e} IS NOT NULL THEN '\"{name}\":' || {e} END" for name, e in fields.items())
    return f"'{{' || concat_ws(',', {parts}) || '}}'"


def _s(e: str) -> str:
    return f"('\"' || replace(replace({e}, '\\', '\\\\'), '\"', '\\\"') || '\"')"


def _t(e: str) -> str:
    return f"CAST({e} AS VARCHAR)"


def _entries_sql() -> str:
    pg = _page_sql("hotel_directory")
    text = {"hotel_id", "hotel_name", "city", "country", "created_at", "room_number", "room_type", "service_id", "service_name",
            "customer_name", "comment", "review_date", "booking_id", "status", "check_in", "check_out", "cancel_reason"}
    source = {"hotel": f"SELECT pg.page_pos, h.* REPLACE (strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at), 1 AS pos "
                       f"FROM hotels h JOIN {pg} pg ON pg.hotel_id = h.hotel_id"}
    b = _placed_bookings(pg)
    source |= {"rooms": _rooms(pg, False), "services": _services(pg), "reviews": _reviews(pg), "bookings": _bookings(pg),
               "booking_rooms": _booking_rooms(b, _LEAD), "booking_cancels": _booking_cancels(b, _LEAD)}
    money = {"price_per_night", "service_charge", "total_amount", "room_amount"}
    out = []
    for number, (section, fields) in enumerate(SECTIONS.items()):
        cells = {f: _s(f) if f in text else _t(f"CAST({f} AS DECIMAL(10,2))") if f in money else _t(f) for f in fields}
        place = "booking_pos AS pos, pos AS sub_pos" if section in ("booking_rooms", "booking_cancels") else "pos, 0 AS sub_pos"
        out.append(f"SELECT page_pos, hotel_id, {number} AS section, {place}, {_json(cells)} AS entry FROM ({source[section]}) s")
    return "\nUNION ALL\n".join(out)


@register("write_documents", f"""
SELECT page_pos, hotel_id, section, CAST(pos AS BIGINT) AS pos, CAST(sub_pos AS BIGINT) AS sub_pos, entry,
       CAST(strlen(entry) AS BIGINT) AS bytes,
       CAST(COALESCE(SUM(strlen(entry)) OVER (PARTITION BY hotel_id ORDER BY section, pos, sub_pos
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {FRAGMENT_BYTES} AS BIGINT) AS fragment
FROM ({_entries_sql()}) e
""")
def write_documents(fx):
    """The directory page's documents, one row per entry with the number of the
    fragment it is written in."""
    return fragment_entries(document_entries(fx, C.DIRECTORY_PAGE))
