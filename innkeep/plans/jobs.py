"""Write paths as batch command jobs.

A job reads a table of requests and returns

* ``status``: one row per request, ``code`` = 'OK' or the first failing
  check's reject code, ``message`` the reference's response text;
* the rows to add or the new snapshot of each target table.

Requests are all-or-nothing, checked in the reference's order, and a batch
gives the result of applying its requests one at a time in ``request_seq``
order.  Checks are joins against key sets (existence flags), never lookups
one id at a time; ids are ``max suffix + rank`` with the distributed rank.
Writing the outputs is the caller's choice (:func:`write_snapshot`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.functions.ids import digits_number, pad5, unsigned_suffix
from innkeep.functions.rules import as_number, parse_date
from innkeep.operators.filters import unique_keys
from innkeep.operators.ranking import global_rank, lag_within_groups
from innkeep.plans import validation as V
from innkeep.session import materialize, staging_path
from innkeep.sources.commands import sanitized

AS_OF = "1999-01-01"          # stands in for NOW()/CURDATE(): a job parameter

# The reference's response messages.
MSG = {
    "HOTEL_NOT_FOUND": "Hotel not found",
    "CUSTOMER_NOT_FOUND": "Customer not found",
    "EMPLOYEE_NOT_FOUND": "Employee not found",
    "NOT_AUTHORIZED_ADD": "You are not authorized to add maintenance records",
    "NOT_AUTHORIZED_UPDATE": "You are not authorized to update maintenance records",
    "MAINTENANCE_NOT_FOUND": "Maintenance record not found",
    "STATUS_UNCHANGED": "Maintenance status is already updated",
    "TOO_MANY_ROOMS": "Cannot insert more rooms than total_rooms value",
    "NOT_ENOUGH_ROOMS": "Not enough rooms available",
    "CANCEL_HOTEL_NOT_FOUND": "Hotel not found, cannot cancel",
    "BOOKING_NOT_FOUND": "Booking not found, cannot cancel",
    "NOT_AUTHORIZED_CANCEL": "You are not authorized to cancel this booking",
}


def room_not_found(room: Column, hotel: Column) -> Column:
    return F.concat(F.lit("Room "), room, F.lit(" not found in hotel "), hotel)


def room_booked(room: Column) -> Column:
    return F.concat(F.lit("Room "), room, F.lit(" is already booked."))


class Outputs(dict):
    """Job outputs built on first access (a value may be a zero-argument
    function), so a caller that needs only the status pays for nothing else."""

    def __getitem__(self, key):
        value = super().__getitem__(key)
        if not isinstance(value, DataFrame) and callable(value):
            value = value()
            super().__setitem__(key, value)
        return value


@dataclass
class JobResult:
    status: DataFrame
    outputs: Outputs = field(default_factory=Outputs)


# -- building blocks ---------------------------------------------------------------
def flag(df: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Left-join a TRUE ``name`` flag where ``on`` exists in ``keys``."""
    k = unique_keys(keys, on)
    return df.join(k.withColumn(name, F.lit(True)), list(on), "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(False)))


def first_failure(checks: Sequence[tuple[Column, str, Column | str]]) -> tuple[Column, Column]:
    """(code, message) of the first check whose condition is not TRUE."""
    code: Column = F.lit("OK")
    msg: Column = F.lit(None).cast("string")
    for ok, c, m in reversed(checks):
        fail = ~F.coalesce(ok, F.lit(False))
        code = F.when(fail, F.lit(c)).otherwise(code)
        msg = F.when(fail, m if isinstance(m, Column) else F.lit(m)).otherwise(msg)
    return code, msg


def last_number(df: DataFrame, id_col: str, start: int | None = None, order_col: str | None = None) -> Column:
    """What the reference reads as the last id's number (scalar subquery):
    the row with the highest ``order_col`` (surrogate id) or, by default, the
    highest numeric suffix from ``start`` (ties: higher digits), then all its
    digits.  0 when the table is empty."""
    c = F.col(id_col)
    if order_col:
        key = F.col(order_col)
    else:
        k = unsigned_suffix(c, start) if start else digits_number(c)
        key = F.struct(k, digits_number(c))
    last = df.agg(F.max_by(id_col, key).alias("_last"))
    return last.select(F.coalesce(digits_number(F.col("_last")), F.lit(0))).scalar()


def assign_ids(df: DataFrame, order: Sequence[str | Column], prefix: str, last: Column,
               id_col: str) -> DataFrame:
    """``prefix + pad5(last + n)`` for the n-th row along ``order`` (n from 1),
    as the reference assigns them one request at a time."""
    ranked = global_rank(df, order, rank_col="_n")
    return ranked.withColumn(id_col, pad5(prefix, last + F.col("_n"))).drop("_n")


def status_frame(df: DataFrame, checks, extra: Sequence[Column] = ()) -> DataFrame:
    code, msg = first_failure(checks)
    return df.select("request_seq", code.alias("code"), msg.alias("message"), *extra)


def write_snapshot(df: DataFrame, name: str, fmt: str = "parquet") -> str:
    """Write a job output to a new path under the shared checkpoint folder
    (never over the input being read); returns the path."""
    import uuid
    path = staging_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("error").format(fmt).save(path)
    return path


def _errors_text() -> Column:
    return F.array_join("errors", " | ")


# -- ingest_reviews -------------------------------------------------------------------
def ingest_reviews(fx, as_of: str = AS_OF) -> JobResult:
    req = sanitized(fx.review_requests())
    v = req.join(V.request_errors(req, V.REVIEW, []), "request_seq")
    v = flag(v, fx.hotels(), ["hotel_id"], "_hotel")
    v = flag(v, fx.customers(), ["customer_id"], "_cust")
    checks = [(F.size("errors") == 0, "VALIDATION", _errors_text()),
              (F.col("_hotel"), "HOTEL_NOT_FOUND", MSG["HOTEL_NOT_FOUND"]),
              (F.col("_cust"), "CUSTOMER_NOT_FOUND", MSG["CUSTOMER_NOT_FOUND"])]
    code, msg = first_failure(checks)
    v = materialize(v.select("request_seq", "hotel_id", "customer_id", "rating", "comment",
                             code.alias("code"), msg.alias("message")))
    ok = v.where(F.col("code") == "OK")
    reviews = fx.reviews()
    new = assign_ids(ok, ["request_seq"], "REV", last_number(reviews, "review_id", 4), "review_id")
    rows = new.select(
        "request_seq", "review_id", "hotel_id", "customer_id",
        # an INT column stores the validated number rounded half away from zero
        F.round(as_number("rating")).cast("int").alias("rating"),
        F.nullif(F.col("comment"), F.lit("")).alias("comment"),
        F.to_date(F.lit(as_of)).alias("review_date"))
    status = v.select("request_seq", "code", "message").join(
        rows.select("request_seq", "review_id"), "request_seq", "left")
    return JobResult(status, Outputs(
        rows=rows,
        snapshot=lambda: reviews.select("review_id", "hotel_id", "customer_id", "rating", "comment",
                                        "review_date").unionByName(rows.drop("request_seq"))))


# -- maintenance -----------------------------------------------------------------------
def _employee_checks(df: DataFrame, fx, who: str) -> tuple[DataFrame, list]:
    emp = fx.employees().select("employee_id", F.col("role").alias("_role"))
    df = df.join(emp, "employee_id", "left")
    return df, [(F.col("_role").isNotNull(), "EMPLOYEE_NOT_FOUND", MSG["EMPLOYEE_NOT_FOUND"]),
                (F.col("_role") == "employee", "NOT_AUTHORIZED", MSG[f"NOT_AUTHORIZED_{who}"])]


def ingest_maintenance(fx) -> JobResult:
    raw = fx.maintenance_requests()
    requests = sanitized(raw)
    items = requests.where(F.col("pos").isNotNull())
    first = F.coalesce("pos", F.lit(0))          # an empty list is one row without a position
    header = (raw.groupBy("request_seq")
              .agg(F.min_by("hotel_id", first).alias("hotel_id"),
                   F.min_by("employee_id", first).alias("employee_id")))
    v = header.join(V.maintenance_errors(fx, requests), "request_seq")
    v, emp_checks = _employee_checks(v, fx, "ADD")
    v = flag(v, fx.hotels(), ["hotel_id"], "_hotel")
    # first item (by position) whose room is not in the request's hotel
    it = items.select("request_seq", "pos", "room_number").join(header.select("request_seq", "hotel_id"),
                                                                 "request_seq")
    it = flag(it, fx.rooms(), ["hotel_id", "room_number"], "_room")
    bad = (it.where(~F.col("_room")).groupBy("request_seq")
           .agg(F.min_by("room_number", "pos").alias("_bad_room")))
    v = v.join(bad, "request_seq", "left")
    checks = emp_checks + [
        (F.size("errors") == 0, "VALIDATION", _errors_text()),
        (F.col("_hotel"), "HOTEL_NOT_FOUND", MSG["HOTEL_NOT_FOUND"]),
        (F.col("_bad_room").isNull(), "ROOM_NOT_FOUND", room_not_found(F.col("_bad_room"), F.col("hotel_id"))),
    ]
    status = materialize(status_frame(v, checks, extra=[F.col("hotel_id"), F.col("employee_id")]))

    def rows():
        ok_items = (items.drop("hotel_id", "employee_id")
                    .join(status.where(F.col("code") == "OK").select("request_seq", "hotel_id", "employee_id"),
                          "request_seq"))
        new = assign_ids(ok_items, ["request_seq", "pos"], "MAINTAIN",
                         last_number(fx.maintenance(), "maintenance_id", 9), "maintenance_id")
        return new.select("request_seq", "pos", "maintenance_id", "hotel_id", "room_number", "employee_id",
                          "issue_description", parse_date(F.col("maintenance_date")).alias("maintenance_date"),
                          F.coalesce("maintenance_status", F.lit("Pending")).alias("maintenance_status"))
    return JobResult(status.select("request_seq", "code", "message"), Outputs(rows=rows))


def update_maintenance(fx) -> JobResult:
    raw = fx.maintenance_updates()
    clean = sanitized(raw)
    req = clean.drop("hotel_id", "employee_id", "maintenance_id").join(
        raw.select("request_seq", "hotel_id", "employee_id", "maintenance_id"), "request_seq")
    v = req.join(V.maintenance_update_errors(fx, clean), "request_seq")
    v, emp_checks = _employee_checks(v, fx, "UPDATE")
    v = flag(v, fx.hotels(), ["hotel_id"], "_hotel")
    v = flag(v, fx.rooms(), ["hotel_id", "room_number"], "_room")
    maint = fx.maintenance().select("maintenance_id", "hotel_id", "room_number",
                                    F.col("maintenance_status").alias("_stored"))
    # one stored status per record key (the reference reads the first match)
    stored = maint.groupBy("maintenance_id", "hotel_id", "room_number").agg(F.min("_stored").alias("_stored"))
    v = v.join(stored, ["maintenance_id", "hotel_id", "room_number"], "left")
    v = v.withColumn("_requested", F.coalesce("maintenance_status", F.lit("Pending")))
    static = emp_checks + [
        (F.size("errors") == 0, "VALIDATION", _errors_text()),
        (F.col("_hotel"), "HOTEL_NOT_FOUND", MSG["HOTEL_NOT_FOUND"]),
        (F.col("_room"), "ROOM_NOT_FOUND", room_not_found(F.col("room_number"), F.col("hotel_id"))),
        (F.col("_stored").isNotNull(), "MAINTENANCE_NOT_FOUND", MSG["MAINTENANCE_NOT_FOUND"]),
    ]
    code, msg = first_failure(static)
    v = materialize(v.select("request_seq", "maintenance_id", "hotel_id", "room_number", "_requested", "_stored",
                             code.alias("_code"), msg.alias("_msg")))
    # Among requests that pass the static checks, the status before a request
    # is the previous such request's requested status (accepted, or rejected
    # because it equalled the then-current one), else the stored status.
    passing = v.where(F.col("_code") == "OK")
    chained = lag_within_groups(passing, ["maintenance_id", "hotel_id", "room_number"], ["request_seq"],
                                ["_requested"])
    chained = chained.withColumn("_current", F.coalesce("prev__requested", "_stored"))
    final = chained.select("request_seq",
                           F.when(F.col("_requested") == F.col("_current"), F.lit("STATUS_UNCHANGED"))
                           .otherwise(F.lit("OK")).alias("code"),
                           F.when(F.col("_requested") == F.col("_current"), F.lit(MSG["STATUS_UNCHANGED"]))
                           .alias("message"),
                           "maintenance_id", "hotel_id", "room_number", "_requested")
    status = (v.where(F.col("_code") != "OK")
              .select("request_seq", F.col("_code").alias("code"), F.col("_msg").alias("message"))
              .unionByName(final.select("request_seq", "code", "message")))

    def changes():
        """The last accepted status of each updated record."""
        return (final.where(F.col("code") == "OK").groupBy("maintenance_id", "hotel_id", "room_number")
                .agg(F.max_by("_requested", "request_seq").alias("maintenance_status")))

    def snapshot():
        latest = changes().withColumnRenamed("maintenance_status", "_new")
        return (fx.maintenance().join(latest, ["maintenance_id", "hotel_id", "room_number"], "left")
                .withColumn("maintenance_status", F.coalesce("_new", "maintenance_status")).drop("_new"))
    return JobResult(status, Outputs(changes=changes, snapshot=snapshot))


# -- cancel_bookings ---------------------------------------------------------------------
def cancel_bookings(fx, literal_rooms: bool = False) -> JobResult:
    raw = fx.cancel_requests()
    clean = sanitized(raw)
    req = clean.drop("booking_id").join(raw.select("request_seq", "booking_id"), "request_seq")
    v = req.join(V.cancel_errors(fx, clean), "request_seq")
    v = flag(v, fx.hotels(), ["hotel_id"], "_hotel")
    b = fx.bookings().select("booking_id", F.col("customer_id").alias("_owner"),
                             F.col("hotel_id").alias("_bhotel"), F.col("total_amount").alias("_amount"))
    v = v.join(b, "booking_id", "left")
    checks = [(F.size("errors") == 0, "VALIDATION", _errors_text()),
              (F.col("_hotel"), "HOTEL_NOT_FOUND", MSG["CANCEL_HOTEL_NOT_FOUND"]),
              (F.col("_owner").isNotNull(), "BOOKING_NOT_FOUND", MSG["BOOKING_NOT_FOUND"]),
              (F.col("_owner") == F.col("customer_id"), "NOT_AUTHORIZED", MSG["NOT_AUTHORIZED_CANCEL"])]
    code, msg = first_failure(checks)
    v = materialize(v.select("request_seq", "booking_id", "customer_id", "hotel_id", "cancel_reason", "_bhotel",
                             "_amount", code.alias("code"), msg.alias("message")))
    ok = v.where(F.col("code") == "OK")
    cancelled = fx.bookings_cancelled()
    new = assign_ids(ok, ["request_seq"], "BOOKCANCEL",
                     last_number(cancelled, "booking_cancel_id", 11), "booking_cancel_id")
    rows = new.select("request_seq", "booking_cancel_id", "booking_id", "customer_id", "hotel_id",
                      F.col("_amount").alias("total_amount"), "cancel_reason")
    status = v.select("request_seq", "code", "message").join(
        rows.select("request_seq", "booking_cancel_id"), "request_seq", "left")

    def rooms_freed():
        # the booking's room numbers, in the booking's hotel (intended) or in
        # every hotel (literal, quirk Q8)
        br = fx.booking_rooms().join(ok.select("booking_id", "_bhotel").distinct(), "booking_id")
        if literal_rooms:
            freed = fx.rooms().join(br.select("room_number").distinct(), "room_number", "left_semi")
        else:
            freed = fx.rooms().join(br.select(F.col("_bhotel").alias("hotel_id"), "room_number").distinct(),
                                    ["hotel_id", "room_number"], "left_semi")
        return freed.select("room_id", "hotel_id", "room_number")

    def bookings_snapshot():
        done = ok.select("booking_id").distinct().withColumn("_c", F.lit(True))
        return (fx.bookings().join(done, "booking_id", "left")
                .withColumn("booking_status", F.when(F.col("_c"), F.lit("Cancelled"))
                            .otherwise(F.col("booking_status"))).drop("_c"))

    def bookings_changes():
        """The cancelled bookings, with the hotel they are stored under."""
        return (ok.groupBy("booking_id").agg(F.min("_bhotel").alias("hotel_id"))
                .withColumn("booking_status", F.lit("Cancelled")))

    def rooms_snapshot():
        freed = rooms_freed().select("room_id").withColumn("_f", F.lit(True))
        return (fx.rooms().join(freed, "room_id", "left")
                .withColumn("is_available", F.when(F.col("_f"), F.lit(True)).otherwise(F.col("is_available")))
                .drop("_f"))
    return JobResult(status, Outputs(rows=rows, rooms_freed=rooms_freed, bookings=bookings_snapshot,
                                     bookings_changes=bookings_changes,
                                     rooms=rooms_snapshot))


# -- hotels ------------------------------------------------------------------------------
def _hotel_items(fx):
    return sanitized(fx.hotel_requests()), sanitized(fx.hotel_request_rooms()), \
        sanitized(fx.hotel_request_services())


def _first_repeat(items: DataFrame, value: Column, name: str, keep: Column | None = None) -> DataFrame:
    """Per request, the item value of the first position that repeats an
    earlier value (the first offender), via the lag over (request, value)."""
    it = items.select("request_seq", "pos", value.alias("_v"), F.col(name).alias("_shown"))
    if keep is not None:
        it = it.where(keep)
    first = it.groupBy("request_seq", "_v").agg(F.min("pos").alias("_p0"))
    rep = it.join(first, ["request_seq", "_v"]).where(F.col("pos") > F.col("_p0"))
    return rep.groupBy("request_seq").agg(F.min_by("_shown", "pos").alias(f"_dup_{name}"))


def ingest_hotels(fx, as_of: str = AS_OF) -> JobResult:
    header, rooms, services = _hotel_items(fx)
    v = header.join(V.hotel_errors(fx, header, rooms, services), "request_seq")
    v = v.where(F.col("hotel_id").isNull()).drop("hotel_id")
    n_rooms = rooms.groupBy("request_seq").agg(F.count(F.lit(1)).alias("_n_rooms"))
    v = (v.join(n_rooms, "request_seq", "left")
         .join(_first_repeat(rooms, F.col("room_number"), "room_number"), "request_seq", "left")
         .join(_first_repeat(services, F.lower("service_name"), "service_name",
                             keep=F.coalesce(F.col("service_name"), F.lit("")) != ""), "request_seq", "left"))
    checks = [(F.size("errors") == 0, "VALIDATION", _errors_text()),
              (F.coalesce("_n_rooms", F.lit(0)) <= as_number("total_rooms"), "TOO_MANY_ROOMS",
               MSG["TOO_MANY_ROOMS"]),
              (F.col("_dup_room_number").isNull(), "DUPLICATE_ROOM",
               F.concat(F.lit("Duplicate room number '"), F.col("_dup_room_number"), F.lit("' found."))),
              (F.col("_dup_service_name").isNull(), "DUPLICATE_SERVICE",
               F.concat(F.lit("Duplicate service name '"), F.col("_dup_service_name"), F.lit("' detected.")))]
    code, msg = first_failure(checks)
    v = materialize(v.select("request_seq", "hotel_name", "city", "country", "total_rooms",
                             code.alias("code"), msg.alias("message")))
    ok = v.where(F.col("code") == "OK")
    hotels = assign_ids(ok, ["request_seq"], "HOT", last_number(fx.hotels(), "hotel_id", order_col="id"),
                        "hotel_id")
    new_hotels = hotels.select("request_seq", "hotel_id", "hotel_name", "city", "country",
                               as_number("total_rooms").cast("int").alias("total_rooms"),
                               F.to_timestamp(F.lit(as_of)).cast("timestamp_ntz").alias("created_at"))
    ids = new_hotels.select("request_seq", "hotel_id")

    def new_rooms():
        out = assign_ids(rooms.join(ids, "request_seq"), ["request_seq", "pos"], "ROOM",
                         last_number(fx.rooms(), "room_id", order_col="id"), "room_id")
        return out.select("request_seq", "pos", "room_id", "hotel_id", "room_number", "room_type",
                          as_number("price_per_night").cast("decimal(10,2)").alias("price_per_night"),
                          F.coalesce("is_available", F.lit(True)).alias("is_available"))

    def new_services():
        named = services.where(F.coalesce(F.col("service_name"), F.lit("")) != "")
        out = assign_ids(named.join(ids, "request_seq"), ["request_seq", "pos"], "SERV",
                         last_number(fx.services(), "service_id"), "new_service_id")
        return out.select("request_seq", "pos", F.col("new_service_id").alias("service_id"), "hotel_id",
                          "service_name", as_number("service_charge").cast("decimal(10,2)").alias("service_charge"))

    status = v.select("request_seq", "code", "message").join(ids, "request_seq", "left")
    return JobResult(status, Outputs(hotels=new_hotels, rooms=new_rooms, services=new_services))


MSG_HOTEL_ID = "Hotel ID is required"   # fixed value


def upsert_hotels(fx) -> JobResult:
    header, rooms, services = _hotel_items(fx)
    v = header.join(V.hotel_errors(fx, header, rooms, services), "request_seq")
    v = v.where(F.col("hotel_id").isNotNull())
    v = flag(v, fx.hotels(), ["hotel_id"], "_hotel")
    checks = [(F.size("errors") == 0, "VALIDATION", _errors_text()),
              (F.col("_hotel"), "HOTEL_NOT_FOUND", MSG["HOTEL_NOT_FOUND"])]
    code, msg = first_failure(checks)
    v = materialize(v.select("request_seq", "hotel_id", "hotel_name", "city", "country", "total_rooms",
                             code.alias("code"), msg.alias("message")))
    ok = v.where(F.col("code") == "OK").select("request_seq", "hotel_id", "hotel_name", "city", "country",
                                               "total_rooms")
    return JobResult(v.select("request_seq", "code", "message"),
                     Outputs(**_upsert_outputs(fx, ok, rooms, services)))


def _upsert_outputs(fx, ok: DataFrame, rooms: DataFrame, services: DataFrame) -> dict:
    # hotel rows: the last accepted request per hotel wins
    def hotel_upd():
        return (ok.groupBy("hotel_id")
                .agg(F.max_by(F.struct("hotel_name", "city", "country", "total_rooms"), "request_seq").alias("u"))
                .select("hotel_id", "u.*"))
    pair: list = []

    def services_pair():
        if not pair:
            pair.append(_upsert_services(fx, ok, services))
        return pair[0]
    def hotels_snapshot():
        u = hotel_upd().select("hotel_id", *[F.col(c).alias(f"_{c}") for c in
                                               ("hotel_name", "city", "country", "total_rooms")])
        h = fx.hotels().join(u, "hotel_id", "left")
        hit = F.col("_hotel_name").isNotNull()
        new = {"hotel_name": F.col("_hotel_name"), "city": F.col("_city"), "country": F.col("_country"),
               # an INT column stores the validated number rounded half away from zero
               "total_rooms": F.round(as_number("_total_rooms")).cast("int")}
        return h.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
                          for c in fx.hotels().columns])
    def services_snapshot():
        upd, new = services_pair()
        u = upd.select("hotel_id", "service_id", F.col("service_name").alias("_n"),
                       F.col("service_charge").alias("_c"), F.lit(True).alias("_hit"))
        cur = (fx.services().join(u, ["hotel_id", "service_id"], "left")
               .select("service_id", "hotel_id",
                       F.when(F.col("_hit"), F.col("_n")).otherwise(F.col("service_name")).alias("service_name"),
                       F.when(F.col("_hit"), as_number("_c").cast("decimal(10,2)"))
                       .otherwise(F.col("service_charge")).alias("service_charge")))
        added = new.select(F.col("new_service_id").alias("service_id"), "hotel_id", "service_name",
                           as_number("service_charge").cast("decimal(10,2)").alias("service_charge"))
        return cur.unionByName(added)
    return {"hotels": hotel_upd,
            "hotels_snapshot": hotels_snapshot,
            "services_snapshot": services_snapshot,
            "rooms": lambda: _rooms_snapshot(fx, *_upsert_rooms(fx, ok, rooms)),
            "rooms_updated": lambda: _upsert_rooms(fx, ok, rooms)[0],
            "services_updated": lambda: services_pair()[0],
            "services_new": lambda: services_pair()[1]}


def _upsert_rooms(fx, ok: DataFrame, rooms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to update, rows to insert)"""
    # rooms: (hotel, room_number) -> last occurrence wins; ids for new numbers
    # follow their first occurrence
    items = rooms.join(ok.select("request_seq", "hotel_id"), "request_seq").select(
        "hotel_id", "request_seq", "pos", "room_number", "room_type",
        as_number("price_per_night").cast("decimal(10,2)").alias("price_per_night"),
        F.coalesce("is_available", F.lit(True)).alias("is_available"))
    order_key = F.struct("request_seq", "pos")
    per_room = (items.groupBy("hotel_id", "room_number")
                .agg(F.max_by(F.struct("room_type", "price_per_night", "is_available"), order_key).alias("u"),
                     F.min(order_key).alias("_first"))
                .select("hotel_id", "room_number", "u.*", "_first"))
    existing = fx.rooms()
    per_room = flag(per_room, existing, ["hotel_id", "room_number"], "_exists")
    updates = per_room.where(F.col("_exists")).drop("_exists", "_first")
    inserts = assign_ids(per_room.where(~F.col("_exists")),
                         [F.col("_first.request_seq"), F.col("_first.pos")], "ROOM",
                         last_number(existing, "room_id", order_col="id"), "room_id")
    return updates, inserts


def _rooms_snapshot(fx, updates: DataFrame, inserts: DataFrame) -> DataFrame:
    upd = updates.select("hotel_id", "room_number", F.col("room_type").alias("_t"),
                         F.col("price_per_night").alias("_p"), F.col("is_available").alias("_a"))
    return (fx.rooms().join(upd, ["hotel_id", "room_number"], "left")
            .select("room_id", "hotel_id", "room_number",
                    F.coalesce("_t", "room_type").alias("room_type"),
                    F.when(F.col("_t").isNotNull(), F.col("_p")).otherwise(F.col("price_per_night")).alias("price_per_night"),
                    F.when(F.col("_t").isNotNull(), F.col("_a")).otherwise(F.col("is_available")).alias("is_available"))
            .unionByName(inserts.select("room_id", "hotel_id", "room_number", "room_type", "price_per_night", "is_available")))


def _upsert_services(fx, ok: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame]:
    # services: a known service_id of the hotel is updated (last wins), any
    # other item is inserted (blank names included, as the reference does)
    svc = services.join(ok.select("request_seq", "hotel_id"), "request_seq")
    svc = flag(svc, fx.services(), ["hotel_id", "service_id"], "_known")
    svc_upd = (svc.where(F.col("_known")).groupBy("hotel_id", "service_id")
               .agg(F.max_by(F.struct("service_name", "service_charge"), F.struct("request_seq", "pos")).alias("u"))
               .select("hotel_id", "service_id", "u.*"))
    svc_new = assign_ids(svc.where(~F.col("_known")), ["request_seq", "pos"], "SERV",
                         last_number(fx.services(), "service_id"), "new_service_id")
    return svc_upd, svc_new
