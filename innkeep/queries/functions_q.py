"""Registered keys: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from innkeep.functions.ids import digits_number, pad5, unsigned_suffix
from innkeep.functions.rules import money_ok, parse_date
from innkeep.functions.text import empty_to_null, js_trim
from innkeep.operators.ranking import page_count
from innkeep.oracle.sqlparts import digits, unsigned_suffix as sql_suffix
from innkeep.registry import register

AS_OF = "1999-01-01"  # job date standing in for NOW()/CURDATE() (deterministic)
MONEY_RE_SQL = "'^[0-9]+(\\.[0-9]{1,2})?$'"


@register("fn_lower", "SELECT hotel_id, lower(city) AS city, lower(country) AS country FROM hotels")
def fn_lower(fx):
    return fx.hotels().select("hotel_id", F.lower("city").alias("city"), F.lower("country").alias("country"))


@register("fn_substring_cast", f"""
SELECT booking_room_id, {sql_suffix('booking_room_id', 3)} AS suffix FROM booking_rooms
""")
def fn_substring_cast(fx):
    """CAST(SUBSTRING(booking_room_id, 3) AS UNSIGNED): 'BR123-4' -> 123."""
    return fx.booking_rooms().select("booking_room_id",
                                     unsigned_suffix(F.col("booking_room_id"), 3).alias("suffix"))


@register("fn_digits", f"SELECT booking_room_id, {digits('booking_room_id')} AS number FROM booking_rooms")
def fn_digits(fx):
    """Number(id.replace(/\\D/g, "")): 'BR123-4' -> 1234."""
    return fx.booking_rooms().select("booking_room_id", digits_number(F.col("booking_room_id")).alias("number"))


@register("fn_pad5", f"""
SELECT booking_id, 'BOOK' || LPAD(CAST({digits('booking_id')} + 1 AS VARCHAR),
       CAST(GREATEST(5, LENGTH(CAST({digits('booking_id')} + 1 AS VARCHAR))) AS INTEGER), '0') AS next_id
FROM bookings
""")
def fn_pad5(fx):
    """Next id after each booking id, padded to five digits, never cut."""
    return fx.bookings().select("booking_id", pad5("BOOK", digits_number(F.col("booking_id")) + 1).alias("next_id"))


@register("fn_round2", """
SELECT booking_room_id,
       CAST((2 * CAST(room_amount * 100 AS BIGINT) + 3) // 6 AS DOUBLE) / 100.0 AS third_amount
FROM booking_rooms
""")
def fn_round2(fx):
    """ROUND(room_amount / 3, 2) on decimals: half away from zero."""
    return fx.booking_rooms().select(
        "booking_room_id", F.round(F.col("room_amount") / 3, 2).cast("double").alias("third_amount"))


@register("fn_ceil", """
SELECT hotel_id, CAST(CEIL(COUNT(*) / 10.0) AS BIGINT) AS review_pages FROM reviews GROUP BY hotel_id
""")
def fn_ceil(fx):
    """Math.ceil(count / 10): pages of reviews per hotel."""
    return fx.reviews().groupBy("hotel_id").agg(page_count(F.count(F.lit(1))).alias("review_pages"))


@register("fn_default", """
SELECT request_seq, NULLIF(regexp_replace(comment, '^\\s+|\\s+$', '', 'g'), '') AS comment,
       COALESCE(TRY_CAST(rating AS DOUBLE), 0) AS rating_or_zero
FROM review_requests
""")
def fn_default(fx):
    """``comment || null`` after trimming and ``Number(x) || 0``."""
    return fx.review_requests().select(
        "request_seq", empty_to_null(js_trim("comment")).alias("comment"),
        F.coalesce(F.col("rating").try_cast("double"), F.lit(0.0)).alias("rating_or_zero"))


@register("fn_trim", """
SELECT request_seq, regexp_replace(comment, '^\\s+|\\s+$', '', 'g') AS comment FROM review_requests
""")
def fn_trim(fx):
    return fx.review_requests().select("request_seq", js_trim("comment").alias("comment"))


@register("fn_now_date", f"""
SELECT hotel_id, CAST(DATE '{AS_OF}' - MAX(review_date) AS BIGINT) AS days_since_review
FROM reviews GROUP BY hotel_id
""")
def fn_now_date(fx):
    """CURDATE() as the job's ``as_of`` date: days since each hotel's latest review."""
    return (fx.reviews().groupBy("hotel_id")
            .agg(F.datediff(F.to_date(F.lit(AS_OF)), F.max("review_date")).cast("long").alias("days_since_review")))


@register("fn_parse_date", """
SELECT request_seq, pos,
       TRY_CAST(check_in AS DATE) IS NOT NULL AS check_in_ok,
       TRY_CAST(check_out AS DATE) IS NOT NULL AS check_out_ok,
       COALESCE(TRY_CAST(check_out AS DATE) > TRY_CAST(check_in AS DATE), false) AS order_ok
FROM booking_request_rooms
""")
def fn_parse_date(fx):
    """Date.parse validity of both dates and check_out > check_in."""
    ci, co = parse_date(F.col("check_in")), parse_date(F.col("check_out"))
    return fx.booking_request_rooms().select(
        "request_seq", "pos", ci.isNotNull().alias("check_in_ok"), co.isNotNull().alias("check_out_ok"),
        F.coalesce(co > ci, F.lit(False)).alias("order_ok"))


@register("fn_parse_number", f"""
SELECT request_seq, CASE WHEN regexp_matches(total_rooms, {MONEY_RE_SQL}) THEN CAST(total_rooms AS DOUBLE) END
       AS total_rooms_number
FROM hotel_requests
""")
def fn_parse_number(fx):
    """Number(total_rooms) for values the number rule accepts."""
    return fx.hotel_requests().select(
        "request_seq", F.when(money_ok(F.col("total_rooms")), F.col("total_rooms").cast("double"))
        .alias("total_rooms_number"))


@register("fn_regex_money", f"""
SELECT request_seq, total_amount, COALESCE(regexp_matches(total_amount, {MONEY_RE_SQL}), false) AS amount_ok
FROM booking_requests
""")
def fn_regex_money(fx):
    return fx.booking_requests().select("request_seq", "total_amount",
                                        F.coalesce(money_ok(F.col("total_amount")), F.lit(False)).alias("amount_ok"))


@register("fn_struct_build", """
SELECT b.booking_id, c.full_name AS customer_name, b.booking_status AS status,
       CAST(b.total_amount AS DOUBLE) AS total_amount
FROM bookings b LEFT JOIN customers c ON c.customer_id = b.customer_id
""")
def fn_struct_build(fx):
    """The booking entry object {booking_id, customer_name, status, total_amount}
    built as a struct, then read back field by field."""
    cust = fx.customers().select("customer_id", F.col("full_name").alias("customer_name"))
    entry = F.struct("booking_id", "customer_name", F.col("booking_status").alias("status"),
                     F.col("total_amount").cast("double").alias("total_amount")).alias("entry")
    return fx.bookings().join(cust, "customer_id", "left").select(entry).select("entry.*")


@register("fn_array_project", """
SELECT q.request_seq, COUNT(i.pos) AS n_rooms,
       COUNT(i.pos) FILTER (WHERE TRY_CAST(i.check_out AS DATE) > TRY_CAST(i.check_in AS DATE)) AS n_ordered,
       COALESCE(string_agg(i.room_number, ',' ORDER BY i.pos), '') AS room_numbers
FROM booking_requests q LEFT JOIN booking_request_rooms i ON i.request_seq = q.request_seq
GROUP BY q.request_seq
""")
def fn_array_project(fx):
    """``rooms.map(..)`` / ``rooms.filter(..)`` on each request's room array:
    ``transform`` and ``filter`` over the nested command document."""
    from innkeep.sources.commands import booking_commands
    cmd = booking_commands(fx)
    rooms = F.col("booking_rooms")
    ordered = F.filter(rooms, lambda r: F.coalesce(parse_date(r["check_out"]) > parse_date(r["check_in"]),
                                                   F.lit(False)))
    return cmd.select(
        "request_seq", F.size(rooms).cast("long").alias("n_rooms"), F.size(ordered).cast("long").alias("n_ordered"),
        F.array_join(F.transform(rooms, lambda r: r["room_number"]), ",").alias("room_numbers"))
