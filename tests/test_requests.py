"""Nested sanitizing, form bodies, rules and audits added to the requests."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from innkeep.plans import validation as V
from innkeep.plans.audit import audit
from innkeep.sources.commands import BOOKING_COMMAND, parse_form, parse_json_lines, sanitized, to_form
from tests.world import booking, customer, hotel, room, world


def test_nested_records_are_cleaned_at_any_depth(spark):
    bad = " <b onclick='x'>a</b><script>y</script> "
    df = spark.createDataFrame([(1, bad, [bad, None], [(bad, [bad], [[(bad,)]])], {"k": bad}, None, [None]), (2, None, None, None, None, (None,), [])],
                               "request_seq long, a string, tags array<string>, items array<struct<f:string,g:array<string>,h:array<array<struct<i:string>>>>>, "
                               "m map<string,string>, s struct<z:string>, n array<struct<q:string>>")
    got = {r.request_seq: r for r in sanitized(df).collect()}
    r = got[1]
    assert r.a == "<b>a</b>" and r.tags == [bad, None] and r.m == {"k": "<b>a</b>"}
    assert r["items"][0].f == "<b>a</b>" and r["items"][0].g == [bad] and r["items"][0].h[0][0].i == "<b>a</b>"
    assert r.s is None and r.n == [None]
    assert got[2].s.z is None and got[2].n == [] and got[2]["items"] is None and got[2].m is None
    assert sanitized(df).schema.simpleString() == df.schema.simpleString()


def bodies(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "request_seq long, body string")


def parsed(spark, *texts):
    return {r.request_seq: r for r in parse_form(bodies(spark, *texts), BOOKING_COMMAND, "booking_rooms").collect()}


def test_form_bodies(spark):
    got = parsed(spark, "customer_id=C+1&hotel_id=H%C3%BC&booking_rooms[1][room_number]=b&booking_rooms%5B0%5D%5Broom_number%5D=a&booking_rooms[0][check_in]=2024-01-01",
                 "", "customer_id", "customer_id=%zz", "customer_id=1&customer_id=2", "booking_rooms[21][room_number]=1", None,
                 "&".join(f"x{i}=1" for i in range(1001)), "customer_id=a%3Db=c&&other=1", "booking_rooms[20][room_number]=1", "&".join(f"x{i}=1" for i in range(1000)))
    assert got[0].customer_id == "C 1" and got[0].hotel_id == "Hü" and got[0]._corrupt_record is None
    assert [(r.pos, r.room_number, r.check_in) for r in got[0].booking_rooms] == [(1, "a", "2024-01-01"), (2, "b", None)]
    assert got[1]._corrupt_record is None and got[1].booking_rooms == [] and got[2].customer_id == ""
    assert [i for i in range(11) if got[i]._corrupt_record is not None] == [3, 4, 5, 7]
    assert got[6].customer_id is None
    assert got[8].customer_id == "a=b=c" and got[9].booking_rooms[0].pos == 1 and got[10].booking_rooms == []


def test_odd_form_bodies(spark):
    got = parsed(spark, "=x&customer_id=a%26b%3Dc%25", "=x&=y", "a%26b=1&a&b=2", "booking_rooms[007][room_number]=1&booking_rooms[7][check_in]=2&booking_rooms[3][other]=3",
                 "%62ooking_rooms%5b2%5D%5broom_number]=a+b&&", "booking_rooms[999999][other]=1", "booking_rooms[1000000][other]=1", "customer%5Fid=1&customer_id=2",
                 "customer_id=%E2%82&hotel_id=%C3%BC%", "customer_id=%FFa\nb==", "&".join(f"booking_rooms[{i}][room_number]={i}" for i in range(20, -1, -1)))
    assert [i for i in range(11) if got[i]._corrupt_record is not None] == [1, 5, 7, 8]
    assert all(got[i].customer_id is None and got[i].booking_rooms is None for i in (1, 5, 7, 8))
    assert got[0].customer_id == "a&b=c%" and got[2].booking_rooms == [] and got[6].booking_rooms == []
    assert [(r.pos, r.room_number, r.check_in) for r in got[3].booking_rooms] == [(1, None, None), (2, None, "2")]
    assert [(r.pos, r.room_number) for r in got[4].booking_rooms] == [(1, "a b")] and got[9].customer_id == "\ufffda\nb=="
    assert [(r.pos, r.room_number) for r in got[10].booking_rooms] == [(i + 1, str(i)) for i in range(21)]


def test_form_bodies_keep_the_shuffles_partitions(spark):
    """Parsing is long for the bytes it reads, so partitions are not merged by
    size: a task's share of the bodies does not grow with them."""
    from innkeep.queries.commands_q import read_commands_form
    w = world(spark, booking_requests=[(i, f"CUST{i:05d}", "HOT00001", "10", None) for i in range(400)],
              booking_request_rooms=[(i, p, str(p), "2024-01-01", "2024-01-02", "5") for i in range(400) for p in (2, 1)])
    df = read_commands_form(w)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.collect()
    bad = {i for i in range(400) if i % 97 == 5 or i % 101 == 7 or i % 103 == 9}
    assert {r.request_seq for r in rows if r.code == "BAD_BODY"} == bad and len(rows) == 2 * (400 - len(bad)) + len(bad)
    assert all((r.pos, r.customer_id) == (int(r.room_number), f"CUST{r.request_seq:05d}") for r in rows if r.code == "OK")


def test_both_encodings_give_the_same_requests(spark):
    rows = [(1, "C & 1", "H=1", None, "50% off", [(1, "101", "2024-01-01", None, "10"), (2, "ü+1", None, None, None)]), (2, None, None, None, None, [])]
    cmd = spark.createDataFrame(rows, BOOKING_COMMAND)
    form = parse_form(to_form(cmd, "booking_rooms"), BOOKING_COMMAND, "booking_rooms").drop("_corrupt_record")
    lines = cmd.select("request_seq", F.to_json(F.struct(*[c for c in cmd.columns if c != "request_seq"])).alias("value"))
    js = parse_json_lines(lines, BOOKING_COMMAND, keep=("request_seq",)).drop("_corrupt_record")
    assert sorted(form.collect()) == sorted(js.collect()) == sorted(cmd.collect())


def test_bodies_cut_short_are_rejects(spark):
    lines = spark.createDataFrame([(1, '{"customer_id": "C", "booking_rooms": [{"room_number": "1"'), (2, '{"customer_id": "C"}')], "request_seq long, value string")
    got = {r.request_seq: r for r in parse_json_lines(lines, BOOKING_COMMAND, keep=("request_seq",)).collect()}
    assert got[1]._corrupt_record is not None and got[1].customer_id is None and got[2]._corrupt_record is None


def test_id_rules(spark):
    w = world(spark, cancel_requests=[(1, "BOOK00001", "CUST00001", "HOT00001", "changed plans", "BOOKCANCEL00001"), (2, "BOOK00001", "CUST00001", "HOT00001", "changed plans", "B" * 21),
                                      (3, "BOOK00001", "CUST00001", "HOT00001", "changed plans", None)],
              maintenance_requests=[(1, 1, "HOT00001", "EMP00001", "101", "leaking tap", "2024-01-01", None, "M" * 21), (2, 1, "HOT00001", "EMP00001", "101", "leaking tap", "2024-01-01", None)])
    assert {r.request_seq: r.errors for r in V.cancel_errors(w).collect()} == {1: [], 2: ["Booking Cancel ID too long"], 3: []}
    assert {r.request_seq: r.errors for r in V.maintenance_errors(w).collect()} == {1: ["Maintenance ID too long"], 2: []}


def test_audit_counts_by_hand(spark):
    w = world(spark, hotels=[hotel(1), hotel(2)], rooms=[room(i, 1 if i < 40 else 7, str(i)) for i in range(60)] + [room(1, 1, "1")],
              customers=[customer(1) + ("a@x.org", "1"), customer(2) + ("a@x.org", "2" * 21), customer(3) + (None, None)],
              bookings=[booking(1, 1, 1), booking(2, 8, 2), booking(2, 8, 2), (4, "BOOK00004", None, None, Decimal("1"), "Other", dt.datetime(2024, 1, 1))],
              maintenance=[("MAINTAIN00001", "HOT00001", "5", "E", "x", None, "Pending"), ("MAINTAIN00002", "HOT00002", "5", "E", "x", None, "Pending"),
                           ("MAINTAIN00003", "HOT00002", None, "E", "x", None, "Pending")])
    got = {(r.table_name, r.constraint_name): r.violations for r in audit(w).collect()}
    assert got["rooms", "fk(hotel_id)->hotels"] == 20 and got["rooms", "unique(room_id)"] == 1
    assert got["customers", "unique(email)"] == 1 and got["customers", "varchar(phone,20)"] == 1
    assert got["bookings", "unique(booking_id)"] == 1 and got["bookings", "fk(customer_id)->customers"] == 2
    assert got["bookings", "not_null(customer_id)"] == 1 and got["bookings", "enum(booking_status)"] == 1
    assert got["maintenance", "fk(hotel_id,room_number)->rooms"] == 1 and got["services", "unique(service_id)"] == 0
    assert len(got) == 83


def test_empty_maintenance_lists(spark):
    """A request with an empty list is one row without a position: the
    employee is looked up first, then the list is refused."""
    from innkeep.plans.jobs import ingest_maintenance
    from innkeep.sources.commands import maintenance_commands
    item = ("101", "leaking tap", "2024-01-01", None, None)
    none = (None,) * 5
    w = world(spark, hotels=[hotel(1)], rooms=[room(1, 1, "101")], maintenance=[],
              employees=[("EMP00001", "HOT00001", "A", "employee", None, None), ("EMP00002", "HOT00001", "B", "admin", None, None)],
              maintenance_requests=[(1, None, "HOT00001", "EMP00001", *none), (2, None, "HOT00001", "EMP00009", *none),
                                    (3, None, "HOT00001", "EMP00002", *none), (4, 7, "HOT00001", "EMP00001", *item),
                                    (4, 8, "HOT00001", "EMP00001", *item), (5, None, "HOT00009", "EMP00001", *none)])
    job = ingest_maintenance(w)
    got = {r.request_seq: (r.code, r.message) for r in job.status.collect()}
    empty = "At least one maintenance record is required"
    assert got[1][0] == got[5][0] == "VALIDATION" and empty in got[1][1] and empty in got[5][1]
    assert [got[i][0] for i in (2, 3, 4)] == ["EMPLOYEE_NOT_FOUND", "NOT_AUTHORIZED", "OK"]
    rows = job.outputs["rows"].orderBy("pos").collect()
    assert [(r.request_seq, r.pos, r.maintenance_id) for r in rows] == [(4, 7, "MAINTAIN00001"), (4, 8, "MAINTAIN00002")]
    assert {r.request_seq: (r.employee_id, len(r.maintenance)) for r in maintenance_commands(w).collect()} == {
        1: ("EMP00001", 0), 2: ("EMP00009", 0), 3: ("EMP00002", 0), 4: ("EMP00001", 2), 5: ("EMP00001", 0)}
