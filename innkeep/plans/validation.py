"""Request validation as data-quality jobs.

Each request schema is declared once as a list of rule specs; the same spec
yields the Spark rule Columns (``innkeep.functions.rules``) and, for the
oracle, a DuckDB list expression.  A request's errors are its header errors
followed by the errors of its items in array order (the validator's issue
order).  Only failing items are grouped per request, and a request's items
are bounded by the request body size, so no group grows with the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.functions import rules as R
from innkeep.functions.sanitize import sanitize_sql
from innkeep.sources.commands import sanitized

MONEY_SQL = "'^[0-9]+(\\.[0-9]{1,2})?$'"


@dataclass
class Spec:
    kind: str                      # string | money | enum | date | range | when
    col: str
    args: dict = field(default_factory=dict)


def S(col, min_len=None, max_len=None, min_msg=None, max_msg=None, required=True):
    return Spec("string", col, dict(min_len=min_len, max_len=max_len, min_msg=min_msg,
                                    max_msg=max_msg, required=required))


def MONEY(col, name, required=True):
    return Spec("money", col, dict(name=name, required=required))


def ENUM(col, values, default=None):
    return Spec("enum", col, dict(values=tuple(values), default=default))


def DATE(col, msg):
    return Spec("date", col, dict(msg=msg))


def RANGE(col, lo, hi, msg):
    """Numeric range checked only when the number rule passed."""
    return Spec("range", col, dict(lo=lo, hi=hi, msg=msg))


def AFTER(col, other, msg):
    """``new Date(col) > new Date(other)``, checked when both dates parse."""
    return Spec("after", col, dict(other=other, msg=msg))


def SERVICE_CHARGE(name_col, charge_col, msg):
    """A named service needs a numeric charge (charge: falsy -> null)."""
    return Spec("service_charge", charge_col, dict(name=name_col, msg=msg))


def EMAIL(col, msg):
    return Spec("email", col, dict(msg=msg))


# Fixed value: a plain e-mail shape (local@domain.tld), no spaces.
EMAIL_RE = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"   # \z: end of input in Java and RE2


# A charge as a decimal number with an optional exponent, and the
# largest values of the tables' DECIMAL(10,2) and INT columns.  A request that
# holds more is rejected by a rule of its own, so it cannot fail its batch.
CHARGE_RE = r"^[ ]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ ]*\z"
MAX_AMOUNT = 99999999.99
MAX_INT = 2147483647


def FITS(col, column):
    return RANGE(col, 0, MAX_INT if column == "total_rooms" else MAX_AMOUNT, f"Out of range value for column '{column}'")


# -- Spark side ----------------------------------------------------------------
def spark_rules(specs: list[Spec]) -> list[R.Rule]:
    out: list[R.Rule] = []
    for s in specs:
        c, a = F.col(s.col), s.args
        if s.kind == "string":
            out += R.string_rules(c, a["min_len"], a["max_len"], a["min_msg"], a["max_msg"], a["required"])
        elif s.kind == "money":
            out += R.money_rules(c, a["name"], a["required"])
        elif s.kind == "enum":
            out += R.enum_rules(c, a["values"], a["default"])
        elif s.kind == "date":
            out += R.date_rules(c, a["msg"])
        elif s.kind == "range":
            n = R.as_number(c)
            out.append(R.Rule(~F.coalesce(R.money_ok(c), F.lit(False)) | n.between(a["lo"], a["hi"]), a["msg"]))
        elif s.kind == "after":
            d1, d2 = R.parse_instant(c), R.parse_instant(F.col(a["other"]))
            out.append(R.Rule(d1.isNull() | d2.isNull() | (d1 > d2), a["msg"]))
        elif s.kind == "service_charge":
            name = F.coalesce(F.col(a["name"]), F.lit(""))
            charge_ok = c.rlike(CHARGE_RE) & (F.abs(c.try_cast("double")) <= MAX_AMOUNT)
            out.append(R.Rule((name == "") | F.coalesce(charge_ok, F.lit(False)), a["msg"]))
        elif s.kind == "email":
            out.append(R.Rule(c.isNull() | c.rlike(EMAIL_RE), a["msg"]))
        else:
            raise ValueError(s.kind)
    return out


def spark_errors(specs: list[Spec]) -> Column:
    return R.errors(spark_rules(specs))


# -- oracle side -----------------------------------------------------------------
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_cases(specs: list[Spec], t: str = "") -> list[str]:
    p = f"{t}." if t else ""
    out = []
    for s in specs:
        c, a = p + s.col, s.args
        if s.kind == "string":
            if a["required"]:
                out.append(f"CASE WHEN {c} IS NULL THEN {_q(R.MSG_MISSING_STRING)} END")
            if a["min_len"] is not None:
                out.append(f"CASE WHEN length({c}) < {a['min_len']} THEN "
                           f"{_q(a['min_msg'] or R.msg_too_small(a['min_len']))} END")
            if a["max_len"] is not None:
                out.append(f"CASE WHEN length({c}) > {a['max_len']} THEN "
                           f"{_q(a['max_msg'] or R.msg_too_big(a['max_len']))} END")
        elif s.kind == "money":
            msg = _q(f"{a['name']} is required and should be a number")
            empty = msg if a["required"] else "NULL"
            out.append(f"CASE WHEN {c} IS NULL THEN {_q(R.MSG_INVALID_INPUT)} WHEN {c} = '' THEN {empty} "
                       f"WHEN NOT regexp_matches({c}, {MONEY_SQL}) THEN {msg} END")
        elif s.kind == "enum":
            vals = ", ".join(_q(v) for v in a["values"])
            ok = f"COALESCE({c} IN ({vals}), false)"
            if a["default"] is not None:
                ok = f"({c} IS NULL OR {ok})"
            out.append(f"CASE WHEN NOT {ok} THEN {_q(R.msg_enum(a['values']))} END")
        elif s.kind == "date":
            out.append(f"CASE WHEN {c} IS NULL THEN {_q(R.MSG_MISSING_STRING)} END")
            out.append(f"CASE WHEN {c} IS NOT NULL AND TRY_CAST(trim({c}) AS DATE) IS NULL THEN {_q(a['msg'])} END")
        elif s.kind == "range":
            out.append(f"CASE WHEN COALESCE(regexp_matches({c}, {MONEY_SQL}), false) AND NOT "
                       f"(TRY_CAST({c} AS DOUBLE) BETWEEN {a['lo']} AND {a['hi']}) THEN {_q(a['msg'])} END")
        elif s.kind == "after":
            o = p + a["other"]
            out.append(f"CASE WHEN TRY_CAST(trim({c}) AS TIMESTAMP) <= TRY_CAST(trim({o}) AS TIMESTAMP) "
                       f"THEN {_q(a['msg'])} END")
        elif s.kind == "service_charge":
            n = p + a["name"]
            out.append(f"CASE WHEN COALESCE({n}, '') <> '' AND NOT COALESCE("
                       f"regexp_matches({c}, {_q(CHARGE_RE)}) AND abs(TRY_CAST({c} AS DOUBLE)) <= {MAX_AMOUNT}, false) THEN {_q(a['msg'])} END")
        elif s.kind == "email":
            out.append(f"CASE WHEN {c} IS NOT NULL AND NOT regexp_matches({c}, {_q(EMAIL_RE)}) "
                       f"THEN {_q(a['msg'])} END")
    return out


def sql_error_list(specs: list[Spec], t: str = "") -> str:
    cases = sql_cases(specs, t)
    if not cases:
        return "CAST([] AS VARCHAR[])"
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def sql_sanitized(view: str, columns: list[str], keep: tuple[str, ...] = ("request_seq", "pos")) -> str:
    cols = [c if c in keep else f"{sanitize_sql(c)} AS {c}" for c in columns]
    return f"(SELECT {', '.join(cols)} FROM {view})"


# -- schemas ---------------------------------------------------------------------
# The request schemas' rules, bounds and custom messages, in
# schema order (fields without a custom message use the library defaults of
# innkeep.functions.rules).
REVIEW = [
    S("hotel_id", 1, 20, "Hotel ID is required"),
    S("customer_id", 1, 20, "Customer ID is required"),
    MONEY("rating", "Rating"),
    RANGE("rating", 1, 5, "Rating must be between 1 and 5"),
    S("comment", None, 1000, max_msg="Comment too long", required=False),
]
CANCEL = [
    S("booking_cancel_id", None, 20, max_msg="Booking Cancel ID too long", required=False),
    S("booking_id", None, 20, max_msg="Booking ID too long", required=False),
    S("customer_id", 1, 20, "Customer ID is required", "Customer ID too long"),
    S("hotel_id", 1, 20, "Hotel ID is required", "Hotel ID too long"),
    S("cancel_reason", 5, 1000, "Cancel reason must be at least 5 characters long", "Cancel reason too long"),
]
BOOKING = [
    S("customer_id", 1, 20, "Customer ID is required"),
    S("hotel_id", 1, 20, "Hotel ID is required"),
    MONEY("total_amount", "Total amount"),
    FITS("total_amount", "total_amount"),
    ENUM("booking_status", ("Confirmed", "Cancelled", "Completed"), default="Confirmed"),
]
BOOKING_ROOM = [
    S("room_number", 1, 20, "Room number is required", "Room number too long"),
    DATE("check_in", "Invalid check-in date"),
    DATE("check_out", "Invalid check-out date"),
    MONEY("room_amount", "Room amount"),
    FITS("room_amount", "room_amount"),
    AFTER("check_out", "check_in", "Check-out date must be after check-in date"),
]
HOTEL = [
    S("hotel_name", 1, 100, "Hotel name is required", "Hotel name must be less than 100 characters"),
    S("city", 1, 100, "City is required", "City must be less than 100 characters"),
    S("country", 1, 100, "Country is required", "Country must be less than 100 characters"),
    MONEY("total_rooms", "Total rooms"),
    FITS("total_rooms", "total_rooms"),
]
HOTEL_ROOM = [
    S("room_number", 1, 10, "Room number is required", "Room number must be less than 10 characters"),
    ENUM("room_type", ("Deluxe", "Suite", "Standard")),
    MONEY("price_per_night", "Price per night"),
    FITS("price_per_night", "price_per_night"),
]
HOTEL_SERVICE = [
    SERVICE_CHARGE("service_name", "service_charge",
                   "If service name is provided, service charge must be a valid number"),
]
MAINTENANCE_ITEM = [
    S("maintenance_id", None, 20, max_msg="Maintenance ID too long", required=False),
    S("room_number", 1, 20, "Room number is required", "Room number too long"),
    S("issue_description", 5, 1000, "Issue description must be at least 5 characters long",
      "Issue description too long"),
    DATE("maintenance_date", "Invalid maintenance date"),
    ENUM("maintenance_status", ("Pending", "Completed", "Cancelled"), default="Pending"),
]
MAINTENANCE_EDIT = [
    S("room_number", 1, 20, "Room number is required", "Room number too long"),
    ENUM("maintenance_status", ("Pending", "Completed", "Cancelled"), default="Pending"),
]
CUSTOMER = [
    S("full_name", 1, 255, "Full name is required", "Full name must be less than 255 characters"),
    EMAIL("email", "Invalid email address"),
    S("email", 1, 255, "Email is required", "Email must be less than 255 characters"),
    S("phone", 1, 20, "Phone number is required", "Phone number must be less than 20 characters"),
    S("city", 1, 100, "City is required", "City must be less than 100 characters"),
    S("country", 1, 100, "Country is required", "Country must be less than 100 characters"),
]

MSG_BOOKING_ROOMS_EMPTY = "At least one room set is required"
MSG_MAINTENANCE_EMPTY = "At least one maintenance record is required"


@dataclass
class ItemPart:
    items: DataFrame
    specs: list[Spec]
    nonempty_msg: str | None = None


def request_errors(header: DataFrame, header_specs: list[Spec], parts: list[ItemPart],
                   key: str = "request_seq") -> DataFrame:
    """(key, errors ARRAY<STRING>) for every header row.  Only failing items are
    grouped, in position order; the item count of the non-empty rule is a plain
    partial aggregate."""
    out = header.select(key, spark_errors(header_specs).alias("_h"))
    names = ["_h"]
    empty = F.array().cast("array<string>")
    for i, p in enumerate(parts):
        name = f"_i{i}"
        failing = p.items.select(key, "pos", spark_errors(p.specs).alias("e")).where(F.size("e") > 0)
        grouped = failing.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("_l"))
        grouped = grouped.select(key, F.flatten(F.transform("_l", lambda x: x["e"])).alias(name))
        out = out.join(grouped, key, "left").withColumn(name, F.coalesce(name, empty))
        names.append(name)
        if p.nonempty_msg:
            nm = f"_e{i}"
            out = out.join(p.items.groupBy(key).agg(F.count(F.lit(1)).alias(f"_n{i}")), key, "left")
            out = out.withColumn(nm, F.when(F.coalesce(f"_n{i}", F.lit(0)) == 0, F.array(F.lit(p.nonempty_msg)))
                                 .otherwise(empty))
            names.append(nm)
    return out.select(key, F.concat(*[F.col(n) for n in names]).alias("errors"))


def sql_request_errors(header_sql: str, header_specs: list[Spec],
                       parts: list[tuple[str, list[Spec], str | None]], key: str = "request_seq") -> str:
    """DuckDB: (key, errors) with the same order as :func:`request_errors`."""
    pieces = [f"{sql_error_list(header_specs, 'h')}"]
    ctes = [f"h AS {header_sql}"]
    joins = ""
    for i, (items_sql, specs, nonempty) in enumerate(parts):
        ctes.append(f"it{i} AS (SELECT {key}, pos, {sql_error_list(specs)} AS e FROM {items_sql} x)")
        ctes.append(f"ie{i} AS (SELECT {key}, flatten(list(e ORDER BY pos)) AS e, COUNT(*) AS n "
                    f"FROM it{i} GROUP BY {key})")
        joins += f" LEFT JOIN ie{i} ON ie{i}.{key} = h.{key}"
        pieces.append(f"COALESCE(list_filter(ie{i}.e, lambda x: x IS NOT NULL), CAST([] AS VARCHAR[]))")
        if nonempty:
            pieces.append(f"CASE WHEN COALESCE(ie{i}.n, 0) = 0 THEN [{_q(nonempty)}] "
                          f"ELSE CAST([] AS VARCHAR[]) END")
    concat = pieces[0]
    for p in pieces[1:]:
        concat = f"list_concat({concat}, {p})"
    return f"WITH {', '.join(ctes)} SELECT h.{key}, {concat} AS errors FROM h{joins}"


# -- per request type (Spark) ------------------------------------------------------
# Each takes the fixture tables and, optionally, the already sanitized request
# frames a job holds, so the sanitizing is not done twice.
def review_errors(fx, req: DataFrame | None = None) -> DataFrame:
    return request_errors(req if req is not None else sanitized(fx.review_requests()), REVIEW, [])


def cancel_errors(fx, req: DataFrame | None = None) -> DataFrame:
    return request_errors(req if req is not None else sanitized(fx.cancel_requests()), CANCEL, [])


def booking_errors(fx, header: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    header = header if header is not None else sanitized(fx.booking_requests())
    items = items if items is not None else sanitized(fx.booking_request_rooms())
    return request_errors(header, BOOKING, [ItemPart(items, BOOKING_ROOM, MSG_BOOKING_ROOMS_EMPTY)])


def hotel_errors(fx, header: DataFrame | None = None, rooms: DataFrame | None = None,
                 services: DataFrame | None = None) -> DataFrame:
    header = header if header is not None else sanitized(fx.hotel_requests())
    rooms = rooms if rooms is not None else sanitized(fx.hotel_request_rooms())
    services = services if services is not None else sanitized(fx.hotel_request_services())
    return request_errors(header, HOTEL, [ItemPart(rooms, HOTEL_ROOM), ItemPart(services, HOTEL_SERVICE)])


def maintenance_errors(fx, items: DataFrame | None = None) -> DataFrame:
    m = items if items is not None else sanitized(fx.maintenance_requests())
    header = m.select("request_seq").distinct()
    return request_errors(header, [], [ItemPart(m.where(F.col("pos").isNotNull()), MAINTENANCE_ITEM, MSG_MAINTENANCE_EMPTY)])


def maintenance_update_errors(fx, req: DataFrame | None = None) -> DataFrame:
    return request_errors(req if req is not None else sanitized(fx.maintenance_updates()), MAINTENANCE_EDIT, [])


# Column lists of the command views (for the SQL side).
COLUMNS = {
    "review_requests": ["request_seq", "hotel_id", "customer_id", "rating", "comment"],
    "cancel_requests": ["request_seq", "booking_id", "customer_id", "hotel_id", "cancel_reason", "booking_cancel_id"],
    "booking_requests": ["request_seq", "customer_id", "hotel_id", "total_amount", "booking_status"],
    "booking_request_rooms": ["request_seq", "pos", "room_number", "check_in", "check_out", "room_amount"],
    "hotel_requests": ["request_seq", "hotel_id", "hotel_name", "city", "country", "total_rooms"],
    "hotel_request_rooms": ["request_seq", "pos", "room_number", "room_type", "price_per_night", "is_available"],
    "hotel_request_services": ["request_seq", "pos", "service_id", "service_name", "service_charge"],
    "maintenance_requests": ["request_seq", "pos", "hotel_id", "employee_id", "room_number", "issue_description",
                             "maintenance_date", "maintenance_status", "maintenance_id"],
    "maintenance_updates": ["request_seq", "maintenance_id", "hotel_id", "room_number", "employee_id",
                            "maintenance_status"],
}

STRING_LIKE_KEEP = ("request_seq", "pos", "is_available")


def sq(view: str) -> str:
    return sql_sanitized(view, COLUMNS[view], keep=STRING_LIKE_KEEP)


SQL_ERRORS = {
    "review_requests": sql_request_errors(sq("review_requests"), REVIEW, []),
    "cancel_requests": sql_request_errors(sq("cancel_requests"), CANCEL, []),
    "booking_requests": sql_request_errors(sq("booking_requests"), BOOKING,
                                           [(sq("booking_request_rooms"), BOOKING_ROOM, MSG_BOOKING_ROOMS_EMPTY)]),
    "hotel_requests": sql_request_errors(sq("hotel_requests"), HOTEL,
                                         [(sq("hotel_request_rooms"), HOTEL_ROOM, None),
                                          (sq("hotel_request_services"), HOTEL_SERVICE, None)]),
    "maintenance_requests": sql_request_errors("(SELECT DISTINCT request_seq FROM maintenance_requests)", [],
                                               [(sq("maintenance_requests"), MAINTENANCE_ITEM,
                                                 MSG_MAINTENANCE_EMPTY)]),
    "maintenance_updates": sql_request_errors(sq("maintenance_updates"), MAINTENANCE_EDIT, []),
}
