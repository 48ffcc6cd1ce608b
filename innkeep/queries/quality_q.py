"""Registered keys: validation, cleaning and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from innkeep.functions.rules import money_ok
from innkeep.functions.sanitize import sanitize_sql, sanitize_text
from innkeep.plans import validation as V
from innkeep.plans.audit import audit, audit_sql
from innkeep.registry import register
from innkeep.sources.commands import nest, sanitized


def _flat(errs):
    return errs.select(errs.columns[0], F.size("errors").cast("long").alias("n_errors"),
                       F.array_join("errors", " | ").alias("errors"))


def _flat_sql(inner: str, key: str = "request_seq") -> str:
    return (f"SELECT {key}, CAST(len(errors) AS BIGINT) AS n_errors, array_to_string(errors, ' | ') AS errors "
            f"FROM ({inner}) v")


@register("validate_reviews", _flat_sql(V.SQL_ERRORS["review_requests"]))
def validate_reviews(fx):
    return _flat(V.review_errors(fx))


@register("validate_cancellations", _flat_sql(V.SQL_ERRORS["cancel_requests"]))
def validate_cancellations(fx):
    return _flat(V.cancel_errors(fx))


@register("validate_bookings", _flat_sql(V.SQL_ERRORS["booking_requests"]))
def validate_bookings(fx):
    return _flat(V.booking_errors(fx))


@register("validate_hotels", _flat_sql(V.SQL_ERRORS["hotel_requests"]))
def validate_hotels(fx):
    return _flat(V.hotel_errors(fx))


@register("validate_maintenance", _flat_sql(V.SQL_ERRORS["maintenance_requests"]))
def validate_maintenance(fx):
    return _flat(V.maintenance_errors(fx))


@register("validate_maintenance_updates", _flat_sql(V.SQL_ERRORS["maintenance_updates"]))
def validate_maintenance_updates(fx):
    return _flat(V.maintenance_update_errors(fx))


_CUSTOMER_HEADER = "(SELECT customer_id, full_name, email, phone, city, country FROM customers)"


@register("validate_customers", _flat_sql(V.sql_request_errors(_CUSTOMER_HEADER, V.CUSTOMER, [], key="customer_id"),
                                          key="customer_id"))
def validate_customers(fx):
    """The (unwired) customer schema over the customers table."""
    c = fx.customers().select("customer_id", "full_name", "email", "phone", "city", "country")
    return _flat(V.request_errors(c, V.CUSTOMER, [], key="customer_id"))


@register("rule_money", """
SELECT request_seq, pos, room_amount,
       COALESCE(room_amount <> '' AND regexp_matches(room_amount, '^[0-9]+(\\.[0-9]{1,2})?$'), false) AS ok,
       CASE WHEN room_amount <> '' AND regexp_matches(room_amount, '^[0-9]+(\\.[0-9]{1,2})?$')
            THEN CAST(room_amount AS DOUBLE) END AS amount
FROM booking_request_rooms
""")
def rule_money(fx):
    """digitsOnly: required, matches the number pattern, then Number()."""
    c = F.col("room_amount")
    ok = F.coalesce((c != "") & money_ok(c), F.lit(False))
    return fx.booking_request_rooms().select("request_seq", "pos", "room_amount", ok.alias("ok"),
                                             F.when(ok, c.cast("double")).alias("amount"))


@register("sanitize_text", f"""
SELECT page_id, {sanitize_sql('html')} AS clean,
       CAST(length(html) - length({sanitize_sql('html')}) AS BIGINT) AS removed_chars
FROM pages
""")
def sanitize_text_key(fx):
    """Unsafe markup stripped from every page's HTML (whole text)."""
    clean = sanitize_text(F.col("html"))
    return (fx.pages().select("page_id", "html", clean.alias("clean"))
            .select("page_id", "clean", (F.length("html") - F.length("clean")).cast("long").alias("removed_chars")))


def _marked(c: str) -> str:
    """A value with markup around it, as SQL that both engines read."""
    return f"'<b onclick=\"x()\">' || {c} || '</b><script>' || {c} || '</script> '"


@register("sanitize_nested", f"""
WITH h AS (SELECT request_seq, {_marked('hotel_name')} AS v, {_marked('city')} AS tag FROM hotel_requests),
r AS (SELECT request_seq, pos, {_marked('room_type')} AS v, price_per_night FROM hotel_request_rooms)
SELECT request_seq, 'hotel_name' AS field, CAST(0 AS BIGINT) AS pos, {sanitize_sql('v')} AS value FROM h
UNION ALL SELECT request_seq, 'tags', CAST(0 AS BIGINT), tag FROM h
UNION ALL SELECT request_seq, 'place.city', CAST(0 AS BIGINT), {sanitize_sql('tag')} FROM h
UNION ALL SELECT request_seq, 'place.links', CAST(0 AS BIGINT), {sanitize_sql('tag')} FROM h
UNION ALL SELECT request_seq, 'rooms.room_type', pos, {sanitize_sql('v')} FROM r
UNION ALL SELECT request_seq, 'rooms.notes', pos, v FROM r
UNION ALL SELECT request_seq, 'rooms.price', pos, price_per_night FROM r
""")
def sanitize_nested(fx):
    """Nested request documents with markup in every string: fields of objects
    are cleaned at any depth (structs, arrays of structs, maps), strings that
    sit directly in arrays stay."""
    head = fx.hotel_requests().selectExpr("request_seq", f"{_marked('hotel_name')} AS hotel_name", f"{_marked('city')} AS tag")
    doc = head.select("request_seq", "hotel_name", F.array("tag").alias("tags"),
                      F.struct(F.col("tag").alias("city"), F.create_map(F.lit("home"), F.col("tag")).alias("links")).alias("place"))
    rooms = fx.hotel_request_rooms().selectExpr("request_seq", "pos", f"{_marked('room_type')} AS room_type",
                                                f"array({_marked('room_type')}) AS notes", "struct(price_per_night AS price) AS paid")
    clean = sanitized(nest(doc, rooms, "rooms"))
    at0 = F.lit(0).cast("long")
    top = clean.select("request_seq", F.inline(F.array(*[
        F.struct(F.lit(name).alias("field"), at0.alias("pos"), value.alias("value")) for name, value in (
            ("hotel_name", F.col("hotel_name")), ("tags", F.col("tags")[0]), ("place.city", F.col("place.city")),
            ("place.links", F.col("place.links")["home"]))])))
    r = clean.select("request_seq", F.explode("rooms").alias("r"))
    items = r.select("request_seq", F.inline(F.array(*[
        F.struct(F.lit(name).alias("field"), F.col("r.pos").alias("pos"), value.alias("value")) for name, value in (
            ("rooms.room_type", F.col("r.room_type")), ("rooms.notes", F.col("r.notes")[0]), ("rooms.price", F.col("r.paid.price")))])))
    return top.unionByName(items)


@register("audit_constraints", audit_sql())
def audit_constraints(fx):
    return audit(fx)


@register("apply_defaults", """
SELECT 'booking_requests' AS source, request_seq, CAST(0 AS BIGINT) AS pos, 'booking_status' AS field,
       COALESCE(booking_status, 'Confirmed') AS value FROM booking_requests
UNION ALL
SELECT 'hotel_request_rooms', request_seq, pos, 'is_available', CAST(COALESCE(is_available, true) AS VARCHAR)
FROM hotel_request_rooms
UNION ALL
SELECT 'maintenance_requests', request_seq, pos, 'maintenance_status', COALESCE(maintenance_status, 'Pending')
FROM maintenance_requests
""")
def apply_defaults(fx):
    """Column defaults of omitted request fields: booking status Confirmed,
    room available TRUE, maintenance status Pending."""
    b = fx.booking_requests().select(F.lit("booking_requests").alias("source"), "request_seq",
                                     F.lit(0).cast("long").alias("pos"), F.lit("booking_status").alias("field"),
                                     F.coalesce("booking_status", F.lit("Confirmed")).alias("value"))
    r = fx.hotel_request_rooms().select(F.lit("hotel_request_rooms").alias("source"), "request_seq", "pos",
                                        F.lit("is_available").alias("field"),
                                        F.coalesce("is_available", F.lit(True)).cast("string").alias("value"))
    m = fx.maintenance_requests().select(F.lit("maintenance_requests").alias("source"), "request_seq", "pos",
                                         F.lit("maintenance_status").alias("field"),
                                         F.coalesce("maintenance_status", F.lit("Pending")).alias("value"))
    return b.unionByName(r).unionByName(m)
