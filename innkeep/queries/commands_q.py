"""Registered keys: write paths as batch command jobs and the
command/document sources and sinks (2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from innkeep.oracle.sqlparts import last_number as sql_last, pad5 as sql_pad5
from innkeep.plans import jobs as J
from innkeep.plans.bookings_job import ingest_bookings as run_ingest_bookings
from innkeep.plans.validation import SQL_ERRORS, sq
from innkeep.registry import register


def _d(c):
    return F.col(c).cast("double").alias(c)


def _s(c):
    return F.col(c).cast("string").alias(c)


def _case(pairs, default="'OK'"):
    """CASE over (failing-condition SQL, value SQL) pairs."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def _q(s):
    return "'" + s.replace("'", "''") + "'"


M = {k: _q(v) for k, v in J.MSG.items()}
ERR_TEXT = "array_to_string(errors, ' | ')"

# -- reviews ------------------------------------------------------------------------------
_REVIEW_CHECKS = [("len(errors) > 0", "'VALIDATION'", ERR_TEXT),
                  ("NOT _hotel", "'HOTEL_NOT_FOUND'", M["HOTEL_NOT_FOUND"]),
                  ("NOT _cust", "'CUSTOMER_NOT_FOUND'", M["CUSTOMER_NOT_FOUND"])]


def _status_cols(checks):
    code = _case([(c, v) for c, v, _ in checks])
    msg = _case([(c, m) for c, _, m in checks], default="NULL")
    return f"{code} AS code, {msg} AS message"


_REVIEWS_BASE = f"""
WITH s AS {sq('review_requests')},
e AS ({SQL_ERRORS['review_requests']}),
v AS (SELECT s.*, e.errors,
             EXISTS (SELECT 1 FROM hotels h WHERE h.hotel_id = s.hotel_id) AS _hotel,
             EXISTS (SELECT 1 FROM customers c WHERE c.customer_id = s.customer_id) AS _cust
      FROM s JOIN e ON e.request_seq = s.request_seq),
c AS (SELECT *, {_status_cols(_REVIEW_CHECKS)} FROM v),
ok AS (SELECT c.*, {sql_pad5('REV', sql_last('reviews', 'review_id', 4) + ' + ROW_NUMBER() OVER (ORDER BY request_seq)')}
              AS review_id
       FROM c WHERE code = 'OK')
"""


@register("ingest_reviews", _REVIEWS_BASE + """
SELECT c.request_seq, c.code, c.message, ok.review_id FROM c LEFT JOIN ok ON ok.request_seq = c.request_seq
""")
def ingest_reviews(fx):
    return J.ingest_reviews(fx).status


@register("append_rows", _REVIEWS_BASE + f"""
SELECT review_id, hotel_id, customer_id, rating, comment, CAST(review_date AS VARCHAR) AS review_date FROM reviews
UNION ALL
SELECT review_id, hotel_id, customer_id, CAST(ROUND(TRY_CAST(rating AS DOUBLE)) AS INTEGER) AS rating,
       NULLIF(comment, '') AS comment, '{J.AS_OF}' AS review_date
FROM ok
""")
def append_rows(fx):
    """INSERT as append: the reviews table plus the accepted new reviews."""
    snap = J.ingest_reviews(fx).outputs["snapshot"]
    return snap.select("review_id", "hotel_id", "customer_id", "rating", "comment", _s("review_date"))


@register("assign_ids", _REVIEWS_BASE + """
SELECT request_seq, review_id FROM ok
""")
def assign_ids(fx):
    """next id = last suffix + rank in request order, for the accepted rows."""
    return J.ingest_reviews(fx).outputs["rows"].select("request_seq", "review_id")


# -- maintenance -----------------------------------------------------------------------------
_EMP_CHECKS = [("role IS NULL", "'EMPLOYEE_NOT_FOUND'", M["EMPLOYEE_NOT_FOUND"])]

_MAINT_BASE = f"""
WITH raw AS (SELECT * FROM maintenance_requests),
items AS {sq('maintenance_requests')},
hdr AS (SELECT request_seq, arg_min(hotel_id, pos) AS hotel_id, arg_min(employee_id, pos) AS employee_id
        FROM raw GROUP BY request_seq),
e AS ({SQL_ERRORS['maintenance_requests']}),
bad AS (SELECT i.request_seq, arg_min(i.room_number, i.pos) AS bad_room
        FROM items i JOIN hdr h ON h.request_seq = i.request_seq
        WHERE NOT EXISTS (SELECT 1 FROM rooms r WHERE r.hotel_id = h.hotel_id AND r.room_number = i.room_number)
        GROUP BY i.request_seq),
v AS (SELECT h.*, e.errors, emp.role, bad.bad_room,
             EXISTS (SELECT 1 FROM hotels x WHERE x.hotel_id = h.hotel_id) AS _hotel
      FROM hdr h JOIN e ON e.request_seq = h.request_seq
      LEFT JOIN employees emp ON emp.employee_id = h.employee_id
      LEFT JOIN bad ON bad.request_seq = h.request_seq),
c AS (SELECT *, {_status_cols(_EMP_CHECKS + [
    ("role <> 'employee'", "'NOT_AUTHORIZED'", M["NOT_AUTHORIZED_ADD"]),
    ("len(errors) > 0", "'VALIDATION'", ERR_TEXT),
    ("NOT _hotel", "'HOTEL_NOT_FOUND'", M["HOTEL_NOT_FOUND"]),
    ("bad_room IS NOT NULL", "'ROOM_NOT_FOUND'", "'Room ' || bad_room || ' not found in hotel ' || hotel_id")])}
      FROM v)
"""


@register("ingest_maintenance", _MAINT_BASE + "SELECT request_seq, code, message FROM c")
def ingest_maintenance(fx):
    return J.ingest_maintenance(fx).status


@register("ingest_maintenance_rows", _MAINT_BASE + f"""
SELECT i.request_seq, i.pos,
       {sql_pad5('MAINTAIN', sql_last('maintenance', 'maintenance_id', 9) + ' + ROW_NUMBER() OVER (ORDER BY i.request_seq, i.pos)')}
         AS maintenance_id,
       h.hotel_id, i.room_number, h.employee_id, i.issue_description,
       CAST(TRY_CAST(trim(i.maintenance_date) AS DATE) AS VARCHAR) AS maintenance_date,
       COALESCE(i.maintenance_status, 'Pending') AS maintenance_status
FROM items i JOIN c ON c.request_seq = i.request_seq AND c.code = 'OK' JOIN hdr h ON h.request_seq = i.request_seq
""")
def ingest_maintenance_rows(fx):
    rows = J.ingest_maintenance(fx).outputs["rows"]
    return rows.select("request_seq", "pos", "maintenance_id", "hotel_id", "room_number", "employee_id",
                       "issue_description", _s("maintenance_date"), "maintenance_status")


_UPD_BASE = f"""
WITH raw AS (SELECT * FROM maintenance_updates),
s AS {sq('maintenance_updates')},
e AS ({SQL_ERRORS['maintenance_updates']}),
stored AS (SELECT maintenance_id, hotel_id, room_number, MIN(maintenance_status) AS st
           FROM maintenance GROUP BY maintenance_id, hotel_id, room_number),
v AS (SELECT r.request_seq, r.maintenance_id, r.hotel_id, r.employee_id, s.room_number, e.errors, emp.role,
             EXISTS (SELECT 1 FROM hotels h WHERE h.hotel_id = r.hotel_id) AS _hotel,
             EXISTS (SELECT 1 FROM rooms x WHERE x.hotel_id = r.hotel_id AND x.room_number = s.room_number) AS _room,
             stored.st AS _stored, COALESCE(s.maintenance_status, 'Pending') AS req
      FROM raw r JOIN s ON s.request_seq = r.request_seq JOIN e ON e.request_seq = r.request_seq
      LEFT JOIN employees emp ON emp.employee_id = r.employee_id
      LEFT JOIN stored ON stored.maintenance_id = r.maintenance_id AND stored.hotel_id = r.hotel_id
                      AND stored.room_number = s.room_number),
c AS (SELECT *, {_status_cols(_EMP_CHECKS + [
    ("role <> 'employee'", "'NOT_AUTHORIZED'", M["NOT_AUTHORIZED_UPDATE"]),
    ("len(errors) > 0", "'VALIDATION'", ERR_TEXT),
    ("NOT _hotel", "'HOTEL_NOT_FOUND'", M["HOTEL_NOT_FOUND"]),
    ("NOT _room", "'ROOM_NOT_FOUND'", "'Room ' || room_number || ' not found in hotel ' || hotel_id"),
    ("_stored IS NULL", "'MAINTENANCE_NOT_FOUND'", M["MAINTENANCE_NOT_FOUND"])])}
      FROM v),
ch AS (SELECT *, COALESCE(LAG(req) OVER (PARTITION BY maintenance_id, hotel_id, room_number ORDER BY request_seq),
                          _stored) AS cur
       FROM c WHERE code = 'OK')
"""


@register("update_maintenance", _UPD_BASE + f"""
SELECT request_seq, code, message FROM c WHERE code <> 'OK'
UNION ALL
SELECT request_seq, CASE WHEN req = cur THEN 'STATUS_UNCHANGED' ELSE 'OK' END,
       CASE WHEN req = cur THEN {M['STATUS_UNCHANGED']} END
FROM ch
""")
def update_maintenance(fx):
    return J.update_maintenance(fx).status


@register("update_rows", _UPD_BASE + """,
acc AS (SELECT maintenance_id, hotel_id, room_number, arg_max(req, request_seq) AS new_status
        FROM ch WHERE req <> cur GROUP BY maintenance_id, hotel_id, room_number)
SELECT m.maintenance_id, m.hotel_id, m.room_number, m.employee_id, m.issue_description,
       CAST(m.maintenance_date AS VARCHAR) AS maintenance_date,
       COALESCE(acc.new_status, m.maintenance_status) AS maintenance_status
FROM maintenance m LEFT JOIN acc ON acc.maintenance_id = m.maintenance_id AND acc.hotel_id = m.hotel_id
                               AND acc.room_number = m.room_number
""")
def update_rows(fx):
    """Keyed UPDATE as a new snapshot: maintenance with the last accepted
    status of each record."""
    snap = J.update_maintenance(fx).outputs["snapshot"]
    return snap.select("maintenance_id", "hotel_id", "room_number", "employee_id", "issue_description",
                       _s("maintenance_date"), "maintenance_status")


@register("authorize_role", """
SELECT 'maintenance_updates' AS gate, r.request_seq,
       CASE WHEN emp.role IS NULL THEN 'EMPLOYEE_NOT_FOUND' WHEN emp.role <> 'employee' THEN 'NOT_AUTHORIZED'
            ELSE 'OK' END AS code
FROM maintenance_updates r LEFT JOIN employees emp ON emp.employee_id = r.employee_id
UNION ALL
SELECT 'cancel_requests' AS gate, q.request_seq,
       CASE WHEN b.booking_id IS NULL THEN 'BOOKING_NOT_FOUND'
            WHEN b.customer_id IS DISTINCT FROM trim(q.customer_id) THEN 'NOT_AUTHORIZED' ELSE 'OK' END AS code
FROM cancel_requests q LEFT JOIN bookings b ON b.booking_id = q.booking_id
""")
def authorize_role(fx):
    """The two authorization gates: the employee role gate of the maintenance
    jobs and the booking-owner gate of cancellations."""
    from innkeep.functions.text import js_trim
    emp = fx.employees().select("employee_id", "role")
    r = fx.maintenance_updates().join(emp, "employee_id", "left")
    code = (F.when(F.col("role").isNull(), "EMPLOYEE_NOT_FOUND").when(F.col("role") != "employee", "NOT_AUTHORIZED")
            .otherwise("OK"))
    roles = r.select(F.lit("maintenance_updates").alias("gate"), "request_seq", code.alias("code"))
    owners = fx.bookings().select("booking_id", F.col("customer_id").alias("_owner"))
    q = fx.cancel_requests().join(owners, "booking_id", "left")
    owner_code = (F.when(F.col("_owner").isNull(), "BOOKING_NOT_FOUND")
                  .when(~F.col("_owner").eqNullSafe(js_trim("customer_id")), "NOT_AUTHORIZED").otherwise("OK"))
    gates = q.select(F.lit("cancel_requests").alias("gate"), "request_seq", owner_code.alias("code"))
    return roles.unionByName(gates)


# -- cancellations -----------------------------------------------------------------------------
_CANCEL_BASE = f"""
WITH raw AS (SELECT * FROM cancel_requests),
s AS {sq('cancel_requests')},
e AS ({SQL_ERRORS['cancel_requests']}),
v AS (SELECT r.request_seq, r.booking_id, s.customer_id, s.hotel_id, s.cancel_reason, e.errors,
             EXISTS (SELECT 1 FROM hotels h WHERE h.hotel_id = s.hotel_id) AS _hotel,
             b.customer_id AS owner, b.hotel_id AS bhotel, b.total_amount AS amount
      FROM raw r JOIN s ON s.request_seq = r.request_seq JOIN e ON e.request_seq = r.request_seq
      LEFT JOIN bookings b ON b.booking_id = r.booking_id),
c AS (SELECT *, {_status_cols([
    ("len(errors) > 0", "'VALIDATION'", ERR_TEXT),
    ("NOT _hotel", "'HOTEL_NOT_FOUND'", M["CANCEL_HOTEL_NOT_FOUND"]),
    ("owner IS NULL", "'BOOKING_NOT_FOUND'", M["BOOKING_NOT_FOUND"]),
    ("owner <> customer_id", "'NOT_AUTHORIZED'", M["NOT_AUTHORIZED_CANCEL"])])}
      FROM v),
ok AS (SELECT c.*, {sql_pad5('BOOKCANCEL', sql_last('bookings_cancelled', 'booking_cancel_id', 11) + ' + ROW_NUMBER() OVER (ORDER BY request_seq)')}
              AS booking_cancel_id
       FROM c WHERE code = 'OK')
"""


@register("cancel_bookings", _CANCEL_BASE + """
SELECT c.request_seq, c.code, c.message, ok.booking_cancel_id
FROM c LEFT JOIN ok ON ok.request_seq = c.request_seq
""")
def cancel_bookings(fx):
    return J.cancel_bookings(fx).status


@register("cancel_bookings_rows", _CANCEL_BASE + """
SELECT request_seq, booking_cancel_id, booking_id, customer_id, hotel_id, CAST(amount AS DOUBLE) AS total_amount,
       cancel_reason
FROM ok
""")
def cancel_bookings_rows(fx):
    rows = J.cancel_bookings(fx).outputs["rows"]
    return rows.select("request_seq", "booking_cancel_id", "booking_id", "customer_id", "hotel_id",
                       _d("total_amount"), "cancel_reason")


@register("cancel_bookings_snapshot", _CANCEL_BASE + """
SELECT b.booking_id,
       CASE WHEN b.booking_id IN (SELECT booking_id FROM ok) THEN 'Cancelled' ELSE b.booking_status END
         AS booking_status
FROM bookings b
""")
def cancel_bookings_snapshot(fx):
    """Keyed UPDATE of booking status as a new bookings snapshot."""
    return J.cancel_bookings(fx).outputs["bookings"].select("booking_id", "booking_status")


@register("cancel_bookings_rooms_freed", _CANCEL_BASE + """
SELECT r.room_id, r.hotel_id, r.room_number FROM rooms r
WHERE EXISTS (SELECT 1 FROM booking_rooms br JOIN ok ON ok.booking_id = br.booking_id
              WHERE ok.bhotel = r.hotel_id AND br.room_number = r.room_number)
""")
def cancel_bookings_rooms_freed(fx):
    """Rooms made available again by the accepted cancellations (in the
    booking's hotel; the literal mode frees the number in every hotel)."""
    return J.cancel_bookings(fx).outputs["rooms_freed"]


# -- hotels --------------------------------------------------------------------------------------
_HOTELS_BASE = f"""
WITH hs AS {sq('hotel_requests')},
rs_ AS {sq('hotel_request_rooms')},
ss AS {sq('hotel_request_services')},
e AS ({SQL_ERRORS['hotel_requests']}),
nr AS (SELECT request_seq, COUNT(*) AS n FROM rs_ GROUP BY request_seq),
rfirst AS (SELECT request_seq, room_number, MIN(pos) AS p0 FROM rs_ GROUP BY request_seq, room_number),
rdup AS (SELECT r.request_seq, arg_min(r.room_number, r.pos) AS dup
         FROM rs_ r JOIN rfirst f ON f.request_seq = r.request_seq AND f.room_number = r.room_number
         WHERE r.pos > f.p0 GROUP BY r.request_seq),
sk AS (SELECT *, lower(service_name) AS lv FROM ss WHERE COALESCE(service_name, '') <> ''),
sfirst AS (SELECT request_seq, lv, MIN(pos) AS p0 FROM sk GROUP BY request_seq, lv),
sdup AS (SELECT s.request_seq, arg_min(s.service_name, s.pos) AS dup
         FROM sk s JOIN sfirst f ON f.request_seq = s.request_seq AND f.lv = s.lv
         WHERE s.pos > f.p0 GROUP BY s.request_seq),
v AS (SELECT h.*, e.errors, COALESCE(nr.n, 0) AS n, rdup.dup AS rdup, sdup.dup AS sdup,
             EXISTS (SELECT 1 FROM hotels x WHERE x.hotel_id = h.hotel_id) AS _hotel
      FROM hs h JOIN e ON e.request_seq = h.request_seq LEFT JOIN nr ON nr.request_seq = h.request_seq
      LEFT JOIN rdup ON rdup.request_seq = h.request_seq LEFT JOIN sdup ON sdup.request_seq = h.request_seq),
c AS (SELECT *, {_status_cols([
    ("len(errors) > 0", "'VALIDATION'", ERR_TEXT),
    ("NOT COALESCE(n <= TRY_CAST(total_rooms AS DOUBLE), false)", "'TOO_MANY_ROOMS'", M["TOO_MANY_ROOMS"]),
    ("rdup IS NOT NULL", "'DUPLICATE_ROOM'", "'Duplicate room number ''' || rdup || ''' found.'"),
    ("sdup IS NOT NULL", "'DUPLICATE_SERVICE'", "'Duplicate service name ''' || sdup || ''' detected.'")])}
      FROM v WHERE hotel_id IS NULL),
okh AS (SELECT request_seq, {sql_pad5('HOT', sql_last('hotels', 'hotel_id', order_col='id') + ' + ROW_NUMBER() OVER (ORDER BY request_seq)')}
               AS new_hotel_id
        FROM c WHERE code = 'OK')
"""


@register("ingest_hotels", _HOTELS_BASE + """
SELECT c.request_seq, c.code, c.message, okh.new_hotel_id AS hotel_id
FROM c LEFT JOIN okh ON okh.request_seq = c.request_seq
""")
def ingest_hotels(fx):
    return J.ingest_hotels(fx).status


@register("ingest_hotels_rooms", _HOTELS_BASE + f"""
SELECT r.request_seq, r.pos,
       {sql_pad5('ROOM', sql_last('rooms', 'room_id', order_col='id') + ' + ROW_NUMBER() OVER (ORDER BY r.request_seq, r.pos)')}
         AS room_id,
       okh.new_hotel_id AS hotel_id, r.room_number, r.room_type,
       CAST(CAST(TRY_CAST(r.price_per_night AS DOUBLE) AS DECIMAL(10,2)) AS DOUBLE) AS price_per_night,
       COALESCE(r.is_available, true) AS is_available
FROM rs_ r JOIN okh ON okh.request_seq = r.request_seq
""")
def ingest_hotels_rooms(fx):
    rows = J.ingest_hotels(fx).outputs["rooms"]
    return rows.select("request_seq", "pos", "room_id", "hotel_id", "room_number", "room_type",
                       _d("price_per_night"), "is_available")


@register("ingest_hotels_services", _HOTELS_BASE + f"""
SELECT s.request_seq, s.pos,
       {sql_pad5('SERV', sql_last('services', 'service_id') + ' + ROW_NUMBER() OVER (ORDER BY s.request_seq, s.pos)')}
         AS service_id,
       okh.new_hotel_id AS hotel_id, s.service_name,
       CAST(CAST(TRY_CAST(s.service_charge AS DOUBLE) AS DECIMAL(10,2)) AS DOUBLE) AS service_charge
FROM sk s JOIN okh ON okh.request_seq = s.request_seq
""")
def ingest_hotels_services(fx):
    rows = J.ingest_hotels(fx).outputs["services"]
    return rows.select("request_seq", "pos", "service_id", "hotel_id", "service_name", _d("service_charge"))


_UPSERT_BASE = _HOTELS_BASE.replace("FROM v WHERE hotel_id IS NULL", "FROM v WHERE hotel_id IS NOT NULL") \
    .replace(_status_cols([
        ("len(errors) > 0", "'VALIDATION'", ERR_TEXT),
        ("NOT COALESCE(n <= TRY_CAST(total_rooms AS DOUBLE), false)", "'TOO_MANY_ROOMS'", M["TOO_MANY_ROOMS"]),
        ("rdup IS NOT NULL", "'DUPLICATE_ROOM'", "'Duplicate room number ''' || rdup || ''' found.'"),
        ("sdup IS NOT NULL", "'DUPLICATE_SERVICE'", "'Duplicate service name ''' || sdup || ''' detected.'")]),
             _status_cols([("len(errors) > 0", "'VALIDATION'", ERR_TEXT),
                           ("NOT _hotel", "'HOTEL_NOT_FOUND'", M["HOTEL_NOT_FOUND"])]))


@register("upsert_hotels_snapshot", _UPSERT_BASE + """,
ok AS (SELECT * FROM c WHERE code = 'OK'),
upd AS (SELECT hotel_id, arg_max(hotel_name, request_seq) AS hn, arg_max(city, request_seq) AS ci,
               arg_max(country, request_seq) AS co, arg_max(total_rooms, request_seq) AS tr
        FROM ok GROUP BY hotel_id)
SELECT h.hotel_id,
       CASE WHEN upd.hotel_id IS NULL THEN h.hotel_name ELSE upd.hn END AS hotel_name,
       CASE WHEN upd.hotel_id IS NULL THEN h.city ELSE upd.ci END AS city,
       CASE WHEN upd.hotel_id IS NULL THEN h.country ELSE upd.co END AS country,
       CASE WHEN upd.hotel_id IS NULL THEN h.total_rooms
            ELSE CAST(ROUND(TRY_CAST(upd.tr AS DOUBLE)) AS INTEGER) END AS total_rooms
FROM hotels h LEFT JOIN upd ON upd.hotel_id = h.hotel_id
""")
def upsert_hotels_snapshot(fx):
    """The hotels table after the upserts (last accepted request per hotel)."""
    snap = J.upsert_hotels(fx).outputs["hotels_snapshot"]
    return snap.select("hotel_id", "hotel_name", "city", "country", "total_rooms")


@register("upsert_hotels_services_snapshot", _UPSERT_BASE + f""",
ok AS (SELECT request_seq, hotel_id FROM c WHERE code = 'OK'),
items AS (SELECT o.hotel_id, s.request_seq, s.pos, s.service_id, s.service_name, s.service_charge,
                 EXISTS (SELECT 1 FROM services x WHERE x.hotel_id = o.hotel_id AND x.service_id = s.service_id)
                   AS known
          FROM ss s JOIN ok o ON o.request_seq = s.request_seq),
upd AS (SELECT hotel_id, service_id,
               arg_max(struct_pack(n := service_name, c := service_charge), struct_pack(a := request_seq, b := pos)) AS u
        FROM items WHERE known GROUP BY hotel_id, service_id)
SELECT x.service_id, x.hotel_id,
       CASE WHEN upd.hotel_id IS NULL THEN x.service_name ELSE upd.u.n END AS service_name,
       CAST(CASE WHEN upd.hotel_id IS NULL THEN x.service_charge
                 ELSE CAST(TRY_CAST(upd.u.c AS DOUBLE) AS DECIMAL(10,2)) END AS DOUBLE) AS service_charge
FROM services x LEFT JOIN upd ON upd.hotel_id = x.hotel_id AND upd.service_id = x.service_id
UNION ALL
SELECT {sql_pad5('SERV', sql_last('services', 'service_id') + ' + ROW_NUMBER() OVER (ORDER BY request_seq, pos)')},
       hotel_id, service_name, CAST(CAST(TRY_CAST(service_charge AS DOUBLE) AS DECIMAL(10,2)) AS DOUBLE)
FROM items WHERE NOT known
""")
def upsert_hotels_services_snapshot(fx):
    """The services table after the upserts: known service ids updated (last
    request wins), every other item inserted with a new id."""
    snap = J.upsert_hotels(fx).outputs["services_snapshot"]
    return snap.select("service_id", "hotel_id", "service_name", _d("service_charge"))


@register("upsert_hotels", _UPSERT_BASE + "SELECT request_seq, code, message FROM c")
def upsert_hotels(fx):
    return J.upsert_hotels(fx).status


@register("upsert_hotels_rooms", _UPSERT_BASE + f""",
ok AS (SELECT request_seq, hotel_id FROM c WHERE code = 'OK'),
items AS (SELECT o.hotel_id, r.request_seq, r.pos, r.room_number, r.room_type,
                 CAST(TRY_CAST(r.price_per_night AS DOUBLE) AS DECIMAL(10,2)) AS price,
                 COALESCE(r.is_available, true) AS avail
          FROM rs_ r JOIN ok o ON o.request_seq = r.request_seq),
per AS (SELECT hotel_id, room_number,
               arg_max(struct_pack(t := room_type, p := price, a := avail), struct_pack(s := request_seq, q := pos)) AS u,
               MIN(struct_pack(s := request_seq, q := pos)) AS first_at
        FROM items GROUP BY hotel_id, room_number),
perx AS (SELECT *, EXISTS (SELECT 1 FROM rooms x WHERE x.hotel_id = per.hotel_id AND x.room_number = per.room_number)
                   AS ex FROM per)
SELECT r.room_id, r.hotel_id, r.room_number, COALESCE(p.u.t, r.room_type) AS room_type,
       CAST(CASE WHEN p.u.t IS NOT NULL THEN p.u.p ELSE r.price_per_night END AS DOUBLE) AS price_per_night,
       CASE WHEN p.u.t IS NOT NULL THEN p.u.a ELSE r.is_available END AS is_available
FROM rooms r LEFT JOIN perx p ON p.ex AND p.hotel_id = r.hotel_id AND p.room_number = r.room_number
UNION ALL
SELECT {sql_pad5('ROOM', sql_last('rooms', 'room_id', order_col='id') + ' + ROW_NUMBER() OVER (ORDER BY first_at.s, first_at.q)')},
       hotel_id, room_number, u.t, CAST(u.p AS DOUBLE), u.a
FROM perx WHERE NOT ex
""")
def upsert_hotels_rooms(fx):
    """The rooms table after the upserts: matched rooms updated (last request
    wins), new room numbers inserted once with fresh ids."""
    snap = J.upsert_hotels(fx).outputs["rooms"]
    return snap.select("room_id", "hotel_id", "room_number", "room_type", _d("price_per_night"), "is_available")


# -- bookings --------------------------------------------------------------------------------------
_BOOKINGS_BASE = f"""
WITH RECURSIVE hs AS {sq('booking_requests')},
its AS {sq('booking_request_rooms')},
e AS ({SQL_ERRORS['booking_requests']}),
rm AS (SELECT hotel_id, room_number, arg_min(is_available, id) AS avail, arg_min(price_per_night, id) AS price
       FROM rooms GROUP BY hotel_id, room_number),
it AS (SELECT i.*, h.hotel_id, rm.avail, rm.price, rm.hotel_id IS NOT NULL AS found,
              MIN(i.pos) OVER (PARTITION BY i.request_seq, i.room_number) AS p0
       FROM its i JOIN hs h ON h.request_seq = i.request_seq
       LEFT JOIN rm ON rm.hotel_id = h.hotel_id AND rm.room_number = i.room_number),
it2 AS (SELECT *, (NOT found) OR NOT COALESCE(avail, false) OR pos > p0 AS sbad FROM it),
nit AS (SELECT request_seq, COUNT(*) AS n, bool_or(sbad) AS anybad FROM it2 GROUP BY request_seq),
v AS (SELECT h.*, e.errors, ht.total_rooms, ht.hotel_id IS NOT NULL AS _hotel, COALESCE(nit.n, 0) AS n,
             COALESCE(nit.anybad, false) AS anybad,
             EXISTS (SELECT 1 FROM customers c WHERE c.customer_id = h.customer_id) AS _cust
      FROM hs h JOIN e ON e.request_seq = h.request_seq LEFT JOIN hotels ht ON ht.hotel_id = h.hotel_id
      LEFT JOIN nit ON nit.request_seq = h.request_seq),
c AS (SELECT *, {_status_cols([
    ("len(errors) > 0", "'VALIDATION'", ERR_TEXT),
    ("NOT _hotel", "'HOTEL_NOT_FOUND'", M["HOTEL_NOT_FOUND"]),
    ("COALESCE(total_rooms, 0) < n", "'NOT_ENOUGH_ROOMS'", M["NOT_ENOUGH_ROOMS"]),
    ("NOT _cust", "'CUSTOMER_NOT_FOUND'", M["CUSTOMER_NOT_FOUND"])])}
      FROM v),
cand AS (SELECT c.request_seq, c.hotel_id, list(it2.room_number ORDER BY it2.pos) AS rooms
         FROM c JOIN it2 ON it2.request_seq = c.request_seq
         WHERE c.code = 'OK' AND NOT c.anybad GROUP BY c.request_seq, c.hotel_id),
candk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY hotel_id ORDER BY request_seq) AS k FROM cand),
walk AS (SELECT hotel_id, k, request_seq, rooms AS taken, true AS acc FROM candk WHERE k = 1
         UNION ALL
         SELECT c.hotel_id, c.k, c.request_seq,
                CASE WHEN list_has_any(w.taken, c.rooms) THEN w.taken ELSE list_concat(w.taken, c.rooms) END,
                NOT list_has_any(w.taken, c.rooms)
         FROM walk w JOIN candk c ON c.hotel_id = w.hotel_id AND c.k = w.k + 1),
acc AS (SELECT request_seq FROM walk WHERE acc),
holder AS (SELECT it2.hotel_id, it2.room_number, it2.request_seq AS h
           FROM it2 JOIN acc ON acc.request_seq = it2.request_seq),
fb AS (SELECT it2.request_seq, arg_min(struct_pack(r := it2.room_number, f := it2.found), it2.pos) AS fb
       FROM it2 LEFT JOIN holder ho ON ho.hotel_id = it2.hotel_id AND ho.room_number = it2.room_number
       WHERE it2.sbad OR COALESCE(ho.h < it2.request_seq, false) GROUP BY it2.request_seq),
st AS (SELECT c.request_seq,
              CASE WHEN c.code <> 'OK' THEN c.code WHEN a.request_seq IS NOT NULL THEN 'OK'
                   WHEN NOT fb.fb.f THEN 'ROOM_NOT_FOUND' ELSE 'ROOM_UNAVAILABLE' END AS code,
              CASE WHEN c.code <> 'OK' THEN c.message WHEN a.request_seq IS NOT NULL THEN NULL
                   WHEN NOT fb.fb.f THEN 'Room ' || fb.fb.r || ' not found in hotel ' || c.hotel_id
                   ELSE 'Room ' || fb.fb.r || ' is already booked.' END AS message
       FROM c LEFT JOIN acc a ON a.request_seq = c.request_seq LEFT JOIN fb ON fb.request_seq = c.request_seq),
okb AS (SELECT request_seq,
               {sql_pad5('BOOK', sql_last('bookings', 'booking_id', 5) + ' + ROW_NUMBER() OVER (ORDER BY request_seq)')}
                 AS booking_id
        FROM st WHERE code = 'OK')
"""


@register("ingest_bookings", _BOOKINGS_BASE + """
SELECT st.request_seq, st.code, st.message, okb.booking_id
FROM st LEFT JOIN okb ON okb.request_seq = st.request_seq
""")
def ingest_bookings(fx):
    return run_ingest_bookings(fx).status


@register("ingest_bookings_rooms_snapshot", _BOOKINGS_BASE + """
SELECT r.room_id, r.hotel_id, r.room_number,
       CASE WHEN EXISTS (SELECT 1 FROM holder x WHERE x.hotel_id = r.hotel_id AND x.room_number = r.room_number)
            THEN false ELSE r.is_available END AS is_available
FROM rooms r
""")
def ingest_bookings_rooms_snapshot(fx):
    """Room flags after the batch: rooms of accepted bookings are taken."""
    return run_ingest_bookings(fx).outputs["rooms"].select("room_id", "hotel_id", "room_number", "is_available")


@register("ingest_bookings_rooms", _BOOKINGS_BASE + f"""
SELECT it2.request_seq, it2.pos,
       {sql_pad5('BR', sql_last('booking_rooms', 'booking_room_id', 3) + ' + ROW_NUMBER() OVER (ORDER BY it2.request_seq, it2.pos)')}
         AS booking_room_id,
       okb.booking_id, it2.room_number,
       CAST(TRY_CAST(trim(it2.check_in) AS DATE) AS VARCHAR) AS check_in,
       CAST(TRY_CAST(trim(it2.check_out) AS DATE) AS VARCHAR) AS check_out,
       CAST(COALESCE(it2.price, 0) AS DOUBLE) AS room_amount
FROM it2 JOIN okb ON okb.request_seq = it2.request_seq
""")
def ingest_bookings_rooms(fx):
    rows = run_ingest_bookings(fx).outputs["booking_rooms"]
    return rows.select("request_seq", "pos", "booking_room_id", "booking_id", "room_number", _s("check_in"),
                       _s("check_out"), _d("room_amount"))


# -- command sources and document sinks ------------------------------------------------------------
# Bodies are spoilt where the request number has these remainders (fixed values).
_SPOILT_JSON = "request_seq % 97 = 5"
_SPOILT_FORM = {"request_seq % 97 = 5": "malformed escape", "request_seq % 101 = 7": "field given twice", "request_seq % 103 = 9": "index too high"}


def _read_sql(bad: str) -> str:
    return f"""
SELECT q.request_seq, CASE WHEN {bad} THEN 'BAD_BODY' ELSE 'OK' END AS code,
       CASE WHEN NOT ({bad}) THEN q.customer_id END AS customer_id, CASE WHEN NOT ({bad}) THEN q.hotel_id END AS hotel_id,
       CASE WHEN NOT ({bad}) THEN q.total_amount END AS total_amount, CASE WHEN NOT ({bad}) THEN q.booking_status END AS booking_status,
       CASE WHEN NOT ({bad}) THEN i.pos END AS pos, CASE WHEN NOT ({bad}) THEN i.room_number END AS room_number,
       CASE WHEN NOT ({bad}) THEN i.check_in END AS check_in, CASE WHEN NOT ({bad}) THEN i.check_out END AS check_out,
       CASE WHEN NOT ({bad}) THEN i.room_amount END AS room_amount
FROM booking_requests q LEFT JOIN booking_request_rooms i ON i.request_seq = q.request_seq AND NOT ({bad})
"""


def _command_rows(cmd):
    """A row per item of each request (one without items, and one rejected
    for its body, has a row without)."""
    code = F.when(F.col("_corrupt_record").isNotNull(), "BAD_BODY").otherwise("OK")
    return (cmd.select("request_seq", code.alias("code"), "customer_id", "hotel_id", "total_amount", "booking_status",
                       F.explode_outer("booking_rooms").alias("r"))
            .select("request_seq", "code", "customer_id", "hotel_id", "total_amount", "booking_status", "r.pos", "r.room_number",
                    "r.check_in", "r.check_out", "r.room_amount"))


@register("read_commands", _read_sql(_SPOILT_JSON.replace("request_seq", "q.request_seq")))
def read_commands(fx):
    """Booking requests as JSON bodies (one document per request), some cut
    short, parsed back with the explicit command schema."""
    from innkeep.sources.commands import BOOKING_COMMAND, booking_commands, parse_json_lines
    cmd = booking_commands(fx, clean=False)
    body = F.to_json(F.struct(*[c for c in cmd.columns if c != "request_seq"]))
    lines = cmd.select("request_seq", body.alias("value")).withColumn(
        "value", F.when(F.expr(_SPOILT_JSON), F.substring("value", F.lit(1), F.length("value") - 3)).otherwise(F.col("value")))
    return _command_rows(parse_json_lines(lines, BOOKING_COMMAND, keep=("request_seq",)))


@register("read_commands_form", _read_sql(" OR ".join(f"q.{c}" for c in _SPOILT_FORM)))
def read_commands_form(fx):
    """The same requests as urlencoded form bodies with bracketed names, some
    spoilt: equal rows for both encodings, rejects for the bad ones."""
    from innkeep.sources.commands import BOOKING_COMMAND, booking_commands, parse_form, to_form
    bodies = to_form(booking_commands(fx, clean=False, spread=True), "booking_rooms")
    spoil = {"malformed escape": "&note=%zz", "field given twice": "&hotel_id=HOT00001&hotel_id=HOT00002",
             "index too high": "&booking_rooms%5B21%5D%5Broom_number%5D=7"}
    body = F.col("body")
    for condition, how in _SPOILT_FORM.items():
        body = F.when(F.expr(condition), F.concat("body", F.lit(spoil[how]))).otherwise(body)
    return _command_rows(parse_form(bodies.withColumn("body", body), BOOKING_COMMAND, "booking_rooms"))
