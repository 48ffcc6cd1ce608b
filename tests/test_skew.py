"""One hotel owns a third of all rooms, reviews and bookings: the answers
still equal the oracle SQL run on the same hand-written tables."""

import random
from decimal import Decimal

import duckdb
import pytest

from innkeep.oracle.compare import compare
from innkeep.registry import ORACLE_RAW, QUERIES, load_all
from tests.world import booking, customer, hotel, room, world

load_all()
KEYS = ["hotel_admin_search", "hotel_directory", "join_app_lookup", "sort_price_asc", "join_app_nest",
        "agg_nest_bookings", "sort_availability", "agg_having_total", "join_left_chain",
        "ingest_reviews", "validate_reviews", "lookup_exists", "append_rows",
        "ingest_bookings", "ingest_bookings_rooms", "validate_bookings", "ingest_bookings_rooms_snapshot",
        "update_maintenance", "update_rows", "authorize_role"]


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(5)
    hot = 1
    hotels = [hotel(i, city=f"NATION_{i % 25}", country="ASIA" if i % 2 else "AFRICA", hours=i)
              for i in range(1, 31)]
    rooms = [room(i, hot if i % 3 == 0 else rnd.randint(2, 30), str(100 + i),
                  available=rnd.random() > 0.3, price=f"{rnd.randint(900, 1000)}.{rnd.randint(0, 99):02d}")
             for i in range(1, 3001)]
    customers = [customer(i) for i in range(1, 51)]
    reviews = [(i, f"REV{i:05d}", f"HOT{(hot if i % 3 == 0 else rnd.randint(2, 30)):05d}",
                f"CUST{rnd.randint(1, 50):05d}", rnd.randint(1, 5), None, None) for i in range(1, 3001)]
    bookings = [booking(i, rnd.randint(1, 50), hot if i % 3 == 0 else rnd.randint(2, 30),
                        status=rnd.choice(["Confirmed", "Cancelled", None]), hours=rnd.randint(0, 500))
                for i in range(1, 1501)]
    br = [(f"BR{i}", f"BOOK{rnd.randint(1, 1500):05d}", str(100 + rnd.randint(1, 50)), None, None,
           Decimal("10.00")) for i in range(1, 2001)]
    bc = [(f"BOOKCANCEL{i}", f"BOOK{rnd.randint(1, 1500):05d}", "CUST00001", "HOT00001", Decimal("1.00"),
           f"reason {i}") for i in range(1, 301)]
    services = [(f"SERV{i:05d}", f"HOT{(i % 30) + 1:05d}", f"svc{i}", Decimal("5.00")) for i in range(1, 61)]
    review_requests = [(i, "HOT00001" if i % 3 == 0 else f"HOT{rnd.randint(2, 40):05d}",
                        f"CUST{rnd.randint(1, 60):05d}", rnd.choice(["4", "4.5", "6", "", "x", "2.25"]),
                        rnd.choice(["", " fine ", None])) for i in range(1, 601)]
    hot_numbers = [r[3] for r in rooms if r[2] == "HOT00001"]
    booking_requests, booking_items = [], []
    for i in range(1, 301):
        hid = "HOT00001" if i % 3 == 0 else f"HOT{rnd.randint(2, 30):05d}"
        booking_requests.append((i, f"CUST{rnd.randint(1, 50):05d}", hid, "99.50", None))
        pool = hot_numbers[:40] if hid == "HOT00001" else [str(100 + rnd.randint(1, 3000))]
        for pos in range(1, rnd.randint(1, 3) + 1):
            booking_items.append((i, pos, rnd.choice(pool), "2024-05-01", "2024-05-03", "10"))
    employees = [(f"EMP{i:05d}", "HOT00001", f"E{i}", "employee" if i % 4 else "chef") for i in range(1, 9)]
    maint_rooms = [r for r in rooms if r[2] == "HOT00001"][:20]
    maintenance = [(f"MAINTAIN{i:05d}", r[2], r[3], "EMP00001", "leak", None, "Pending")
                   for i, r in enumerate(maint_rooms, start=1)]
    statuses = ["Pending", "Completed", "Cancelled"]
    updates = []
    for i in range(1, 601):
        m = maintenance[0] if i % 3 == 0 else rnd.choice(maintenance)      # one record gets a third
        updates.append((i, m[0], m[1], m[2], f"EMP{rnd.randint(1, 9):05d}", rnd.choice(statuses + [None])))
    fs = world(spark, hotels=hotels, rooms=rooms, customers=customers, reviews=reviews, bookings=bookings,
               booking_rooms=br, bookings_cancelled=bc, services=services, review_requests=review_requests,
               booking_requests=booking_requests, booking_request_rooms=booking_items, employees=employees,
               maintenance=maintenance, maintenance_updates=updates, cancel_requests=[])
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in ["hotels", "rooms", "customers", "reviews", "bookings", "booking_rooms", "bookings_cancelled",
                 "services", "review_requests", "booking_requests", "booking_request_rooms", "employees",
                 "maintenance", "maintenance_updates", "cancel_requests"]:
        pdf = fs.table(name).toPandas()
        con.register(f"{name}_pdf", pdf)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_pdf")
    return fs, con


@pytest.mark.parametrize("key", KEYS)
def test_skewed_world_matches_oracle(key, skewed):
    fs, con = skewed
    ok, msg = compare(QUERIES[key](fs), ORACLE_RAW[key], con)
    assert ok, msg
