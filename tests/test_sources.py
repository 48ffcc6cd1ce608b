"""Command JSON source (with a malformed line) and the snapshot sink."""

import os
import tempfile

from pyspark.sql import functions as F

from innkeep.plans.jobs import write_snapshot
from innkeep.sources.commands import BOOKING_COMMAND, read_command_json


def test_read_command_json_keeps_corrupt_lines(spark):
    d = tempfile.mkdtemp(prefix="innkeep-json-")
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write('{"request_seq": 1, "customer_id": "CUST00001", "hotel_id": "HOT00001", "total_amount": "10",'
                ' "booking_rooms": [{"pos": 1, "room_number": "101", "check_in": "2024-01-01",'
                ' "check_out": "2024-01-02", "room_amount": "10"}]}\n')
        f.write('{"request_seq": 2, "customer_id": \n')
    rows = read_command_json(spark, d, BOOKING_COMMAND).orderBy(F.col("request_seq").asc_nulls_last()).collect()
    assert rows[0].request_seq == 1 and rows[0].booking_rooms[0].room_number == "101"
    assert rows[0]._corrupt_record is None
    assert rows[1]._corrupt_record is not None


def test_write_snapshot_goes_to_a_new_path(spark):
    df = spark.range(5)
    p1, p2 = write_snapshot(df, "t"), write_snapshot(df, "t")
    assert p1 != p2
    assert spark.read.parquet(p1).count() == 5


def test_nested_command_documents_keep_every_item_in_order(fx):
    from innkeep.sources.commands import hotel_commands, maintenance_commands
    h = hotel_commands(fx)
    n_rooms = fx.hotel_request_rooms().count()
    n_services = fx.hotel_request_services().count()
    sizes = h.select(F.sum(F.size("rooms")).alias("r"), F.sum(F.size("services")).alias("s")).first()
    assert (sizes.r, sizes.s) == (n_rooms, n_services)
    assert h.count() == fx.hotel_requests().count()
    m = maintenance_commands(fx)
    assert m.select(F.sum(F.size("maintenance"))).first()[0] == fx.maintenance_requests().count()
    for row in m.limit(20).collect():
        positions = [it.pos for it in row.maintenance]
        assert positions == sorted(positions)
