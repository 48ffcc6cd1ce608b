"""Every job: one status row per request (accepted + rejected = requests),
and new ids unique and gap-free after the table's last id."""

import pytest
from pyspark.sql import functions as F

from innkeep.plans import jobs as J
from innkeep.plans.bookings_job import ingest_bookings

JOBS = {
    "ingest_reviews": (J.ingest_reviews, "review_requests", [("rows", "review_id", "REV")]),
    "ingest_maintenance": (J.ingest_maintenance, "maintenance_requests", [("rows", "maintenance_id", "MAINTAIN")]),
    "update_maintenance": (J.update_maintenance, "maintenance_updates", []),
    "cancel_bookings": (J.cancel_bookings, "cancel_requests", [("rows", "booking_cancel_id", "BOOKCANCEL")]),
    "ingest_hotels": (J.ingest_hotels, None, [("hotels", "hotel_id", "HOT"), ("rooms", "room_id", "ROOM"),
                                              ("services", "service_id", "SERV")]),
    "upsert_hotels": (J.upsert_hotels, None, []),
    "ingest_bookings": (ingest_bookings, "booking_requests", [("bookings", "booking_id", "BOOK"),
                                                             ("booking_rooms", "booking_room_id", "BR")]),
}


@pytest.mark.parametrize("name", sorted(JOBS))
def test_status_covers_requests_and_ids_are_dense(name, fx):
    job, requests, id_outputs = JOBS[name]
    res = job(fx)
    seqs = [r.request_seq for r in res.status.select("request_seq").collect()]
    assert len(seqs) == len(set(seqs))
    if requests:
        want = {r.request_seq for r in fx.table(requests).select("request_seq").distinct().collect()}
        assert set(seqs) == want
    elif name == "ingest_hotels":
        assert len(seqs) == fx.hotel_requests().where(F.col("hotel_id").isNull()).count()
    else:
        assert len(seqs) == fx.hotel_requests().where(F.col("hotel_id").isNotNull()).count()
    for out, col, prefix in id_outputs:
        nums = sorted(int(r[0][len(prefix):]) for r in res.outputs[out].select(col).collect())
        assert nums == list(range(nums[0], nums[0] + len(nums))) if nums else True
