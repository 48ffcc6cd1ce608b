"""Hand-written cases for rules and ids (expected values are written out here)."""

import duckdb
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innkeep.functions.ids import pad5
from innkeep.functions.sanitize import sanitize_sql, sanitize_text
from innkeep.operators.ranking import rank_within_groups
from innkeep.plans import validation as V
from innkeep.sources.commands import parse_json_lines


def test_ids_stay_unique_past_five_digits(spark):
    ids = spark.range(99_990, 100_020).select("id", pad5("CUST", F.col("id")).alias("c"))
    rows = ids.collect()
    assert len({r.c for r in rows}) == 30 and rows[0].c == "CUST99990" and rows[-1].c == "CUST100019"
    assert ids.join(ids.select("c"), "c").count() == 30


def test_missing_parents_are_no_ids(fx):
    assert fx.bookings().filter("customer_id = 'CUST00000'").count() > 0
    assert fx.customers().filter("customer_id = 'CUST00000'").count() == 0
    assert fx.hotels().filter("hotel_id = 'HOT00000'").count() == 0


def messages(spark, specs, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r.e for r in df.select(V.spark_errors(specs).alias("e")).collect()]


def test_service_charge(spark):
    bad = ["If service name is provided, service charge must be a valid number"]
    rows = [("spa", "12.5"), ("spa", "1e3"), ("spa", " 7 "), ("spa", "NaN"), ("spa", "5d"), ("spa", "Infinity"), ("spa", "1e9"),
            ("spa", ""), ("spa", None), ("", None), (None, "x"), ("spa", "100000000")]
    got = messages(spark, V.HOTEL_SERVICE, rows, "service_name string, service_charge string")
    assert got == [[], [], [], bad, bad, bad, bad, bad, bad, [], [], bad]


def test_values_the_tables_cannot_hold(spark):
    got = messages(spark, V.HOTEL, [("h", "c", "c", "2147483647"), ("h", "c", "c", "99999999999")],
                   "hotel_name string, city string, country string, total_rooms string")
    assert got == [[], ["Out of range value for column 'total_rooms'"]]
    got = messages(spark, V.BOOKING, [("c", "h", "99999999.99", None), ("c", "h", "100000000", None)],
                   "customer_id string, hotel_id string, total_amount string, booking_status string")
    assert got == [[], ["Out of range value for column 'total_amount'"]]


def test_same_day_stay_and_long_comment(spark):
    late = ["Check-out date must be after check-in date"]
    rows = [("1", "2024-01-05T10:00:00", "2024-01-05T18:00:00", "1"), ("1", "2024-01-05", "2024-01-05", "1"), ("1", "2024-01-05", "2024-01-06", "1")]
    got = messages(spark, V.BOOKING_ROOM, rows, "room_number string, check_in string, check_out string, room_amount string")
    assert got == [[], late, []]
    got = messages(spark, V.REVIEW, [("h", "c", "5", "x" * 1001)], "hotel_id string, customer_id string, rating string, comment string")
    assert got == [["Comment too long"]]


def test_malformed_bodies_are_kept(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    rows = parse_json_lines(spark.createDataFrame([('{"a": 1}',), ("{oops",), ('{"a": "x"}',)], "value string"), schema).collect()
    assert [(r.a, r._corrupt_record) for r in rows] == [(1, None), (None, "{oops"), (None, '{"a": "x"}')]


def test_rank_keeps_rows_without_a_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "g string, v int")
    got = {(r.g, r.v): r.pos for r in rank_within_groups(df, ["g"], ["v"]).collect()}
    assert got == {("a", 1): 1, ("a", 2): 2, (None, 3): 1, (None, 4): 2}


SANITIZED = [
    ("<p>set one = 1</p>", "<p>set one = 1</p>"),
    ("3 < 5 and one=1", "3 < 5 and one=1"),
    ("<img/src=x/onerror=alert(1)>", '<img src="x/onerror=alert(1)">'),
    ("<img src=x onerror=alert(1)>", '<img src="x">'),
    ("<a href='java\tscript:x()'>go</a>", "<a>go</a>"),
    ("<a href='&#106;avascript:x()'>go</a>", "<a>go</a>"),
    ("<a HREF=/x/y title='say \"hi\"'>t</a>", '<a href="/x/y" title="say &quot;hi&quot;">t</a>'),
    ("<scr<script></script>ipt>alert(1)</script>", "ipt>alert(1)"),
    ("<<foo>script>alert(1)", "&lt;script>alert(1)"),
    ("<b>x</b><script>alert(1)", "<b>x</b>"),
    ("a <img src=x onerror=alert(1)", 'a <img src="x">'),
    ("a<!-- c --><br/>b <input disabled>", 'a<br>b <input disabled="">'),
    ("<svg><path d='M0 0'></path></svg><object>kept</object>", '<svg><path d="M0 0"></path></svg>kept'),
    ("<!doctype html><html><head><title>t</title></head><body><p>x</p></body></html>", "<p>x</p>"),
    ("", ""), (None, None),
    ("x" * 100_000 + "<p>" + "y " * 100_000, "x" * 100_000 + "<p>" + ("y " * 100_000).strip()),
]


def test_sanitizer_cleans_tags_and_keeps_text(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(SANITIZED)], "i int, s string")
    assert [r[0] for r in df.orderBy("i").select(sanitize_text("s")).collect()] == [want for _, want in SANITIZED]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (i INT, s VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", [(i, text) for i, (text, _) in enumerate(SANITIZED)])
    assert [r[0] for r in con.execute(f"SELECT {sanitize_sql('s')} FROM d ORDER BY i").fetchall()] == [want for _, want in SANITIZED]


def test_chain_keeps_every_cancel_reason(spark):
    from innkeep.operators.aggregates import booking_chain
    b = spark.createDataFrame([("B1", "H1", "C1", "Confirmed"), ("B2", "H1", "C9", None)],
                              "booking_id string, hotel_id string, customer_id string, booking_status string")
    c = spark.createDataFrame([("C1", "Ann")], "customer_id string, full_name string")
    r = spark.createDataFrame([("R1", "B1", "101"), ("R2", "B1", "102")], "booking_room_id string, booking_id string, room_number string")
    r = r.selectExpr("*", "DATE'2024-01-01' check_in", "DATE'2024-01-02' check_out", "1.0 room_amount")
    x = spark.createDataFrame([("X1", "B1", "late"), ("X2", "B1", "ill"), ("X3", "B1", None)],
                              "booking_cancel_id string, booking_id string, cancel_reason string")
    got = {(g.kind, g.booking_id, g.part_id, g.room_number, g.cancel_reason, g.customer_name, g.chain_rows)
           for g in booking_chain(b, c, r, x).collect()}
    assert got == {("room", "B1", "R1", "101", None, "Ann", 3), ("room", "B1", "R2", "102", None, "Ann", 3),
                   ("cancel", "B1", "X1", None, "late", "Ann", 2), ("cancel", "B1", "X2", None, "ill", "Ann", 2),
                   ("cancel", "B1", "X3", None, None, "Ann", 2), ("room", "B2", None, None, None, None, 1)}
