"""Reusable DuckDB SQL fragments for the oracle statements.

Averages are reproduced exactly in integer arithmetic: AVG of an INT or
DECIMAL(10,2) column is a decimal with four more fractional digits (rounded
half up), which ROUND(.., 2) rounds half up again."""

from __future__ import annotations


def round2_avg_int(total: str, count: str) -> str:
    """ROUND(AVG(int_col), 2) as DOUBLE, from SUM and COUNT (both > 0)."""
    avg4 = f"((2 * ({total}) * 10000 + ({count})) // (2 * ({count})))"
    return f"(CAST((({avg4}) + 50) // 100 AS DOUBLE) / 100.0)"


def round2_avg_cents(total_cents: str, count: str) -> str:
    """ROUND(AVG(decimal(10,2)), 2) as DOUBLE, from SUM(cents) and COUNT."""
    avg6 = f"((2 * ({total_cents}) * 10000 + ({count})) // (2 * ({count})))"
    return f"(CAST((({avg6}) + 5000) // 10000 AS DOUBLE) / 100.0)"


def ts_text(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def pages(total: str) -> str:
    return f"CAST(CEIL(({total}) / 10.0) AS BIGINT)"


def digits(col: str) -> str:
    """Number(id.replace(/\\D/g, ''))"""
    return f"COALESCE(TRY_CAST(NULLIF(regexp_replace({col}, '[^0-9]', '', 'g'), '') AS BIGINT), 0)"


def unsigned_suffix(col: str, start: int) -> str:
    """CAST(SUBSTRING(col, start) AS UNSIGNED): leading digits, else 0."""
    return (f"COALESCE(TRY_CAST(NULLIF(regexp_extract(substring({col}, {start}), '^[ \\t\\n\\x0B\\f\\r]*([0-9]+)', 1), '')"
            f" AS BIGINT), 0)")


# Per-hotel aggregate CTEs over every hotel (restricting them to a page is a
# plan optimisation only; the left joins give the same rows).
AGG_CTES = """
rs AS (SELECT hotel_id, COUNT(*) AS room_count,
              COUNT(*) FILTER (WHERE is_available) AS avail,
              SUM(CAST(price_per_night * 100 AS BIGINT)) AS price_cents,
              COUNT(price_per_night) AS priced
       FROM rooms GROUP BY hotel_id),
rv AS (SELECT hotel_id, SUM(rating) AS rsum, COUNT(*) AS rcnt FROM reviews GROUP BY hotel_id),
sv AS (SELECT hotel_id, COUNT(*) AS n_services FROM services GROUP BY hotel_id),
bk AS (SELECT hotel_id, COUNT(*) FILTER (WHERE booking_status IS DISTINCT FROM 'Cancelled') AS total_bookings,
              COUNT(*) AS n_bookings
       FROM bookings GROUP BY hotel_id),
bkl AS (SELECT b.hotel_id, COUNT(*) AS total_bookings
        FROM bookings b
        LEFT JOIN customers c ON b.customer_id = c.customer_id
        LEFT JOIN booking_rooms br ON b.booking_id = br.booking_id
        LEFT JOIN bookings_cancelled bc ON b.booking_id = bc.booking_id
        WHERE b.booking_status IS DISTINCT FROM 'Cancelled'
        GROUP BY b.hotel_id)
"""

AVG_RATING = f"COALESCE(CASE WHEN rv.rcnt > 0 THEN {round2_avg_int('rv.rsum', 'rv.rcnt')} END, 0.0)"
AVG_PRICE_RAW = f"CASE WHEN rs.priced > 0 THEN {round2_avg_cents('rs.price_cents', 'rs.priced')} END"
AVG_PRICE = f"COALESCE({AVG_PRICE_RAW}, 0.0)"


def card_select(h: str = "h", bookings: bool = True, price: bool = False, literal: bool = False,
                created: bool = True) -> str:
    """Select list of one hotel card (flat)."""
    cols = [f"{h}.hotel_id", f"{h}.hotel_name", f"{h}.city", f"{h}.country", f"{h}.total_rooms"]
    if created:
        cols.append(f"{ts_text(h + '.created_at')} AS created_at")
    cols += [
        "CAST(COALESCE(rs.avail, 0) AS BIGINT) AS total_rooms_available",
        f"{AVG_RATING} AS average_rating",
        "CAST(COALESCE(rv.rcnt, 0) AS BIGINT) AS total_reviews",
        "CAST(COALESCE(rs.room_count, 0) AS BIGINT) AS n_rooms",
        "CAST(COALESCE(sv.n_services, 0) AS BIGINT) AS n_services",
    ]
    if price:
        cols.append(f"{AVG_PRICE} AS average_price_per_night")
    if bookings:
        b = "bkl" if literal else "bk"
        cols += [f"CAST(COALESCE({b}.total_bookings, 0) AS BIGINT) AS total_bookings",
                 "CAST(COALESCE(bk.n_bookings, 0) AS BIGINT) AS n_bookings"]
    return ", ".join(cols)


def card_joins(h: str = "h", bookings: bool = True, literal: bool = False) -> str:
    j = (f" LEFT JOIN rs ON rs.hotel_id = {h}.hotel_id"
         f" LEFT JOIN rv ON rv.hotel_id = {h}.hotel_id"
         f" LEFT JOIN sv ON sv.hotel_id = {h}.hotel_id")
    if bookings:
        j += f" LEFT JOIN bk ON bk.hotel_id = {h}.hotel_id"
        if literal:
            j += f" LEFT JOIN bkl ON bkl.hotel_id = {h}.hotel_id"
    return j


def pad5(prefix: str, n: str) -> str:
    """prefix + String(n).padStart(5, '0') (never truncates)."""
    s = f"CAST(({n}) AS VARCHAR)"
    return f"('{prefix}' || LPAD({s}, CAST(GREATEST(5, LENGTH({s})) AS INTEGER), '0'))"


def last_number(table: str, col: str, start: int | None = None, order_col: str | None = None) -> str:
    """Scalar subquery: digits of the id the reference reads as the last one."""
    if order_col:
        key = order_col
    else:
        k = unsigned_suffix(col, start) if start else digits(col)
        key = f"struct_pack(k := {k}, d := {digits(col)})"
    return f"(SELECT COALESCE({digits(f'arg_max({col}, {key})')}, 0) FROM {table})"
