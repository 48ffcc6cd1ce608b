"""Small hand-written worlds for job and quirk tests."""

import datetime as dt
from decimal import Decimal

from innkeep.sources.frames import FrameSet

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def hotel(i, total_rooms=10, city="Paris", country="France", hours=0):
    return (i, f"HOT{i:05d}", f"Hotel {i}", city, country, None, total_rooms, T0 + dt.timedelta(hours=hours))


def room(i, h, number, available=True, price="100.00", rtype="Standard"):
    return (i, f"ROOM{i:05d}", f"HOT{h:05d}", number, rtype, Decimal(price) if price is not None else None,
            available)


def customer(i, name=None):
    return (i, f"CUST{i:05d}", name or f"Customer {i}", "Paris", "France")


def booking(i, cust, h, status="Confirmed", amount="10.00", hours=0):
    return (i, f"BOOK{i:05d}", f"CUST{cust:05d}", f"HOT{h:05d}", Decimal(amount), status,
            T0 + dt.timedelta(hours=hours))


def world(spark, **tables):
    return FrameSet(spark, tables)
