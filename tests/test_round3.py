"""Steps that must not repeat work: items of a batch, rules."""

from innkeep.plans import validation as V
from innkeep.plans.bookings_job import ingest_bookings
from innkeep.sources.frames import SCHEMAS
from tests.world import customer, hotel, room, world


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_have_no_lambda(spark):
    """A lambda is interpreted row by row, with all rules in it."""
    df = spark.createDataFrame([("1", "2024-02-01", "2024-02-03", "10")], "room_number string, check_in string, check_out string, room_amount string")
    assert "lambda" not in _plan(df.select(V.spark_errors(V.BOOKING_ROOM).alias("e")))


def test_items_of_a_batch_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(row):
        seen.add(1)
        return row

    items = [(1, 1, "101", "2024-02-01", "2024-02-03", "10"), (1, 2, "101", "2024-02-01", "2024-02-03", "10"),
             (2, 1, "101", "bad", "2024-02-03", "x"), (2, 2, None, "2024-02-01", "2024-02-01", "10"),
             (3, 1, "102", "2024-02-01", "2024-02-03", "10"), (None, 1, "102", "2024-02-01", "2024-02-03", "10")]
    rows = spark.createDataFrame(spark.sparkContext.parallelize(items, 2).map(count), SCHEMAS["booking_request_rooms"])
    requests = [(n, "CUST00001", "HOT00001", "10", None) for n in (1, 2, 3, 3, 4)]
    fs = world(spark, hotels=[hotel(1, total_rooms=3)], rooms=[room(1, 1, "101"), room(2, 1, "102")], customers=[customer(1)],
               booking_requests=requests, bookings=[], booking_rooms=[])
    fs.set("booking_request_rooms", rows)
    job = ingest_bookings(fs)
    got = sorted({(r.request_seq, r.code, r.message) for r in job.status.collect()})
    assert got == [(1, "ROOM_UNAVAILABLE", "Room 101 is already booked."),
                   (2, "VALIDATION", "Invalid check-in date | Room amount is required and should be a number | "
                                     "Invalid input: expected string, received undefined | Check-out date must be after check-in date"),
                   (3, "OK", None), (4, "VALIDATION", V.MSG_BOOKING_ROOMS_EMPTY)]
    assert job.outputs["booking_rooms"].where("request_seq <> 3").count() == 0
    assert seen.value == len(items)


def test_audit_has_partitions_for_its_rows(spark, monkeypatch):
    """A shuffle's tasks share the rows, however few partitions are set."""
    from innkeep.plans import audit as A
    name, used = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(name)
    monkeypatch.setattr(A, "ROWS_A_TASK", 2, raising=False)
    keys = A._key_violations

    def noted(fx):
        used.append(int(spark.conf.get(name)))
        return keys(fx)

    monkeypatch.setattr(A, "_key_violations", noted)
    fs = world(spark, hotels=[hotel(1)], rooms=[room(i, 1 + i % 2, str(100 + i)) for i in range(20)], customers=[customer(1)])
    got = {(r.table_name, r.constraint_name): r.violations for r in A.audit(fs).collect()}
    assert used == [11] and spark.conf.get(name) == before
    assert got["rooms", "fk(hotel_id)->hotels"] == 10 and got["rooms", "unique(room_id)"] == 0
