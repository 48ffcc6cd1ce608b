"""Validation messages, number rule, sanitizer."""

from pyspark.sql import functions as F

from innkeep.functions.sanitize import sanitize_text
from innkeep.functions.text import js_trim
from innkeep.plans import validation as V
from tests.world import world


def _errs(spark, rows):
    fs = world(spark, review_requests=rows)
    return {r.request_seq: list(r.errors) for r in V.review_errors(fs).collect()}


def test_review_rating_rules(spark):
    e = _errs(spark, [(1, "HOT00001", "CUST00001", "4.5", ""), (2, "HOT00001", "CUST00001", "3.125", None),
                      (3, "HOT00001", "CUST00001", "", None), (4, "HOT00001", "CUST00001", "6", None),
                      (5, "", "CUST00001", "0", "x" * 1001)])
    assert e[1] == []
    assert e[2] == ["Rating is required and should be a number"]
    assert e[3] == ["Rating is required and should be a number"]
    assert e[4] == ["Rating must be between 1 and 5"]
    assert e[5] == ["Hotel ID is required", "Rating must be between 1 and 5",
                    "Comment too long"]


def test_booking_items_in_position_order(spark):
    fs = world(spark, booking_requests=[(1, "CUST00001", "HOT00001", "10", "Unknown"), (2, "C", "H", "1", None)],
               booking_request_rooms=[(1, 2, "", "2024-01-02", "2024-01-01", "1"),
                                      (1, 1, "101", "nope", "2024-01-01", "1.234")])
    e = {r.request_seq: list(r.errors) for r in V.booking_errors(fs).collect()}
    assert e[1] == ['Invalid option: expected one of "Confirmed"|"Cancelled"|"Completed"',
                    "Invalid check-in date", "Room amount is required and should be a number",
                    "Room number is required", "Check-out date must be after check-in date"]
    assert e[2] == ["At least one room set is required"]


def test_service_charge_rule(spark):
    fs = world(spark, hotel_requests=[(1, None, "H", "C", "X", "2")],
               hotel_request_rooms=[],
               hotel_request_services=[(1, 1, None, "", None), (1, 2, None, "Spa", None),
                                       (1, 3, None, "Gym", "0"), (1, 4, None, "Bar", "abc")])
    e = {r.request_seq: list(r.errors) for r in V.hotel_errors(fs).collect()}
    msg = "If service name is provided, service charge must be a valid number"
    assert e[1] == [msg, msg]


def test_sanitize_and_trim(spark):
    df = spark.createDataFrame([("  <b onclick=\"x()\">hi</b><script>alert(1)</script> ",),
                                ("<a href='javascript:evil()'>go</a> ",), ("plain",)], "s string")
    got = [r[0] for r in df.select(sanitize_text(F.col("s"))).collect()]
    assert got == ["<b>hi</b>", "<a>go</a>", "plain"]
    assert df.select(js_trim(F.lit("　 x ﻿"))).first()[0] == "x"
