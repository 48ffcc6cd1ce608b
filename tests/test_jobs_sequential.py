"""Stateful jobs equal applying their requests one at a time (plain-Python
simulations of the reference) on random small worlds."""

import random

import pytest

from innkeep.plans.jobs import update_maintenance
from tests.world import hotel, room, world

STATUSES = ["Pending", "Completed", "Cancelled"]


def simulate_updates(employees, hotels, rooms, maint, updates):
    role = {e[0]: e[3] for e in employees}
    hotel_ids = {h[1] for h in hotels}
    room_keys = {(r[2], r[3]) for r in rooms}
    current = {(m[0], m[1], m[2]): m[6] for m in maint}
    codes = {}
    for seq, mid, hid, rnum, emp, status in sorted(updates):
        if emp not in role:
            codes[seq] = "EMPLOYEE_NOT_FOUND"
        elif role[emp] != "employee":
            codes[seq] = "NOT_AUTHORIZED"
        elif not rnum or (status is not None and status not in STATUSES):
            codes[seq] = "VALIDATION"
        elif hid not in hotel_ids:
            codes[seq] = "HOTEL_NOT_FOUND"
        elif (hid, rnum) not in room_keys:
            codes[seq] = "ROOM_NOT_FOUND"
        elif (mid, hid, rnum) not in current:
            codes[seq] = "MAINTENANCE_NOT_FOUND"
        elif current[(mid, hid, rnum)] == (status or "Pending"):
            codes[seq] = "STATUS_UNCHANGED"
        else:
            current[(mid, hid, rnum)] = status or "Pending"
            codes[seq] = "OK"
    return codes, current


@pytest.mark.parametrize("seed", [11, 12])
def test_update_maintenance_equals_sequential(spark, seed):
    rnd = random.Random(seed)
    hotels = [hotel(1), hotel(2)]
    rooms = [room(i, h, str(100 + n)) for i, (h, n) in enumerate([(1, 1), (1, 2), (2, 1), (2, 3)], start=1)]
    employees = [("EMP00001", "HOT00001", "A", "employee"), ("EMP00002", "HOT00001", "B", "chef")]
    maint = [(f"MAINTAIN{i:05d}", f"HOT{h:05d}", str(100 + n), "EMP00001", "leaky tap", None, rnd.choice(STATUSES))
             for i, (h, n) in enumerate([(1, 1), (1, 2), (2, 1), (2, 3)], start=1)]
    updates = []
    for seq in range(1, 81):
        m = rnd.choice(maint + [("MAINTAIN00099", "HOT00001", "101", None, None, None, None)])
        hid = m[1] if rnd.random() > 0.1 else "HOT00009"
        rnum = m[2] if rnd.random() > 0.1 else rnd.choice(["102", "", "103"])
        emp = rnd.choice(["EMP00001"] * 6 + ["EMP00002", "EMP00009"])
        status = rnd.choice(STATUSES * 3 + [None, "Unknown"])
        updates.append((seq, m[0], hid, rnum, emp, status))
    fs = world(spark, hotels=hotels, rooms=rooms, employees=employees, maintenance=maint,
               maintenance_updates=updates)
    res = update_maintenance(fs)
    got = {r.request_seq: r.code for r in res.status.collect()}
    want, final = simulate_updates(employees, hotels, rooms, maint, updates)
    assert got == want
    snap = {(r.maintenance_id, r.hotel_id, r.room_number): r.maintenance_status
            for r in res.outputs["snapshot"].collect()}
    assert snap == final


def simulate_upsert_rooms(hotels, rooms, requests, items):
    hotel_ids = {h[1] for h in hotels}
    table = {r[1]: [r[2], r[3], r[4], float(r[5]), r[6]] for r in rooms}
    by_key = {(r[2], r[3]): r[1] for r in rooms}
    next_num = int(max(rooms, key=lambda r: r[0])[1][4:]) + 1
    codes = {}
    for seq, hid, name, city, country, total in sorted(requests):
        its = sorted((i for i in items if i[0] == seq), key=lambda i: i[1])
        valid = bool(name) and all(i[2] and i[3] in ("Deluxe", "Suite", "Standard") for i in its)
        if not valid:
            codes[seq] = "VALIDATION"
            continue
        if hid not in hotel_ids:
            codes[seq] = "HOTEL_NOT_FOUND"
            continue
        codes[seq] = "OK"
        for _, _, number, rtype, price, avail in its:
            attrs = [hid, number, rtype, float(price), True if avail is None else avail]
            if (hid, number) in by_key:
                table[by_key[(hid, number)]] = attrs
            else:
                rid = f"ROOM{next_num:05d}"
                next_num += 1
                table[rid] = attrs
                by_key[(hid, number)] = rid
    return codes, table


@pytest.mark.parametrize("seed", [21, 22])
def test_upsert_rooms_equals_sequential(spark, seed):
    from innkeep.plans.jobs import upsert_hotels
    rnd = random.Random(seed)
    hotels = [hotel(1), hotel(2)]
    rooms = [room(i, 1 + i % 2, str(100 + i)) for i in range(1, 7)]
    requests, items = [], []
    for seq in range(1, 25):
        hid = rnd.choice(["HOT00001", "HOT00002", "HOT00007"])
        requests.append((seq, hid, "" if rnd.random() < 0.1 else "Name", "City", "Country", "9"))
        for pos in range(1, rnd.randint(0, 4) + 1):
            items.append((seq, pos, str(rnd.choice(range(101, 111))), rnd.choice(["Suite", "Standard", "Deluxe"]),
                          f"{rnd.randint(50, 300)}.5", rnd.choice([True, False, None])))
    fs = world(spark, hotels=hotels, rooms=rooms, hotel_requests=requests, hotel_request_rooms=items)
    res = upsert_hotels(fs)
    got_codes = {r.request_seq: r.code for r in res.status.collect()}
    want_codes, want_rooms = simulate_upsert_rooms(hotels, rooms, requests, items)
    assert got_codes == want_codes
    got_rooms = {r.room_id: [r.hotel_id, r.room_number, r.room_type, float(r.price_per_night), r.is_available]
                 for r in res.outputs["rooms"].collect()}
    assert got_rooms == want_rooms


def simulate_ingest_hotels(hotels, rooms, services, requests, items, svcs):
    """Add-hotel requests one at a time: checks in the reference's order,
    ids continuing from the last hotel/room (by surrogate id) and service."""
    next_h = int(max(hotels, key=lambda h: h[0])[1][3:]) + 1
    next_r = int(max(rooms, key=lambda r: r[0])[1][4:]) + 1
    next_s = max(int(s[0][4:]) for s in services) + 1
    out = {}
    new_rooms, new_services = [], []
    for seq, _, name, city, country, total in sorted(requests):
        its = sorted((i for i in items if i[0] == seq), key=lambda i: i[1])
        ss = sorted((x for x in svcs if x[0] == seq), key=lambda x: x[1])
        if not name:
            out[seq] = ("VALIDATION", None)
            continue
        if len(its) > float(total):
            out[seq] = ("TOO_MANY_ROOMS", None)
            continue
        seen, dup = set(), None
        for i in its:
            if i[2] in seen:
                dup = i[2]
                break
            seen.add(i[2])
        if dup:
            out[seq] = ("DUPLICATE_ROOM", f"Duplicate room number '{dup}' found.")
            continue
        seen, dup = set(), None
        for x in ss:
            if not x[3]:
                continue
            if x[3].lower() in seen:
                dup = x[3]
                break
            seen.add(x[3].lower())
        if dup:
            out[seq] = ("DUPLICATE_SERVICE", f"Duplicate service name '{dup}' detected.")
            continue
        hid = f"HOT{next_h:05d}"
        next_h += 1
        out[seq] = ("OK", hid)
        for i in its:
            new_rooms.append((f"ROOM{next_r:05d}", hid, i[2]))
            next_r += 1
        for x in ss:
            if x[3]:
                new_services.append((f"SERV{next_s:05d}", hid, x[3]))
                next_s += 1
    return out, new_rooms, new_services


@pytest.mark.parametrize("seed", [31, 32])
def test_ingest_hotels_equals_sequential(spark, seed):
    from innkeep.plans.jobs import ingest_hotels
    rnd = random.Random(seed)
    hotels = [hotel(1), hotel(7)]
    rooms = [room(3, 1, "101"), room(9, 7, "102")]
    services = [("SERV00004", "HOT00001", "Spa", None), ("SERV00011", "HOT00007", "Gym", None)]
    requests, items, svcs = [], [], []
    for seq in range(1, 21):
        requests.append((seq, None, "" if rnd.random() < 0.1 else f"H{seq}", "City", "Country",
                         str(rnd.choice([1, 2, 3, 4]))))
        for pos in range(1, rnd.randint(0, 4) + 1):
            items.append((seq, pos, str(rnd.choice(range(101, 106))), "Suite", "99.5", None))
        for pos in range(1, rnd.randint(0, 3) + 1):
            svcs.append((seq, pos, None, rnd.choice(["Spa", "spa", "Bar", "", "Gym"]), "5"))
    fs = world(spark, hotels=hotels, rooms=rooms, services=[s[:3] + (None,) for s in services],
               hotel_requests=requests, hotel_request_rooms=items, hotel_request_services=svcs)
    res = ingest_hotels(fs)
    got = {r.request_seq: (r.code, r.hotel_id if r.code == "OK" else (r.message if r.code.startswith("DUP") else None))
           for r in res.status.collect()}
    want, want_rooms, want_services = simulate_ingest_hotels(hotels, rooms, services, requests, items, svcs)
    assert got == want
    assert sorted((r.room_id, r.hotel_id, r.room_number) for r in res.outputs["rooms"].collect()) == sorted(want_rooms)
    assert sorted((s.service_id, s.hotel_id, s.service_name)
                  for s in res.outputs["services"].collect()) == sorted(want_services)
