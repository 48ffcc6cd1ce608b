"""ingest_bookings: the batch result equals applying the requests one at a
time (a plain-Python simulation of the reference), on random small worlds."""

import random

import pytest

from innkeep.plans.bookings_job import ingest_bookings
from tests.world import customer, hotel, room, world


def simulate(hotels, rooms, customers, requests, items):
    """Sequential reference semantics with rollback of a failed request."""
    avail = {(r[2], r[3]): r[6] for r in sorted(rooms, key=lambda r: -r[0])}  # first by id wins
    total = {h[1]: h[6] for h in hotels}
    custs = {c[1] for c in customers}
    out = {}
    for seq, cust, hid, amount, status in sorted(requests):
        its = sorted((i for i in items if i[0] == seq), key=lambda i: i[1])
        if not its or amount == "abc":
            out[seq] = "VALIDATION"
            continue
        if hid not in total:
            out[seq] = "HOTEL_NOT_FOUND"
            continue
        if total[hid] < len(its):
            out[seq] = "NOT_ENOUGH_ROOMS"
            continue
        if cust not in custs:
            out[seq] = "CUSTOMER_NOT_FOUND"
            continue
        taken, code = [], "OK"
        for _, _, number, *_ in its:
            if (hid, number) not in avail:
                code = "ROOM_NOT_FOUND"
                break
            if not avail[(hid, number)]:
                code = "ROOM_UNAVAILABLE"
                break
            avail[(hid, number)] = False
            taken.append((hid, number))
        if code != "OK":
            for k in taken:
                avail[k] = True
        out[seq] = code
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_equals_sequential(spark, seed):
    rnd = random.Random(seed)
    hotels = [hotel(1, total_rooms=3), hotel(2, total_rooms=2), hotel(3, total_rooms=5)]
    rooms, rid = [], 0
    for h in (1, 2, 3):
        for n in range(101, 107):
            rid += 1
            rooms.append(room(rid, h, str(n), available=rnd.random() > 0.2))
    customers = [customer(i) for i in range(1, 6)]
    requests, items = [], []
    for seq in range(1, 61):
        hid = rnd.choice(["HOT00001", "HOT00002", "HOT00003", "HOT00003", "HOT00009"])
        cust = rnd.choice([f"CUST{i:05d}" for i in range(1, 7)])
        amount = "abc" if rnd.random() < 0.05 else "120.50"
        requests.append((seq, cust, hid, amount, None))
        for pos in range(1, rnd.choice([0, 1, 1, 2, 2, 3, 4]) + 1):
            items.append((seq, pos, str(rnd.choice(range(101, 109))), "2024-02-01", "2024-02-03", "10"))
    fs = world(spark, hotels=hotels, rooms=rooms, customers=customers, booking_requests=requests,
               booking_request_rooms=items, bookings=[], booking_rooms=[])
    res = ingest_bookings(fs)
    got = {r.request_seq: r.code for r in res.status.collect()}
    want = simulate(hotels, rooms, customers, requests, items)
    assert got == want
    ok = sorted(s for s, c in want.items() if c == "OK")
    ids = {r.request_seq: r.booking_id for r in res.status.collect() if r.code == "OK"}
    assert [ids[s] for s in ok] == [f"BOOK{i:05d}" for i in range(1, len(ok) + 1)]
    # a claimed room is claimed once
    br = res.outputs["booking_rooms"].collect()
    assert len({(r.booking_id, r.room_number) for r in br}) == len(br)
    assert len(br) == sum(1 for i in items if want[i[0]] == "OK")


def test_conflict_chain_rounds_bounded_by_rooms(spark):
    """Each request overlaps the next (r_i wants rooms i and i+1): the
    batch still equals the sequential result and needs at most rooms + 1
    rounds, whatever the number of requests."""
    from innkeep.plans.bookings_job import settle_claims
    n = 30
    hotels = [hotel(1, total_rooms=50)]
    rooms = [room(i, 1, str(100 + i)) for i in range(1, n + 2)]
    customers = [customer(1)]
    requests = [(i, "CUST00001", "HOT00001", "10", None) for i in range(1, n + 1)]
    items = [(i, p, str(100 + i + p - 1), "2024-02-01", "2024-02-03", "10") for i in range(1, n + 1) for p in (1, 2)]
    fs = world(spark, hotels=hotels, rooms=rooms, customers=customers, booking_requests=requests,
               booking_request_rooms=items, bookings=[], booking_rooms=[])
    got = {r.request_seq: r.code for r in ingest_bookings(fs).status.collect()}
    assert got == simulate(hotels, rooms, customers, requests, items)
    assert settle_claims.last_rounds <= len(rooms) + 1
