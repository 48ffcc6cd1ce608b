"""Literal vs intended answers on small hand-written worlds."""

from decimal import Decimal

from innkeep.operators import aggregates as agg
from innkeep.plans.directory import HotelAnswers
from innkeep.plans.jobs import cancel_bookings
from tests.world import booking, customer, hotel, room, world


def test_q4_booking_count_literal_counts_joined_rows(spark):
    fs = world(spark, hotels=[hotel(1)], customers=[customer(1)],
               bookings=[booking(1, 1, 1), booking(2, 1, 1, status="Cancelled"), booking(3, 1, 1, status=None)],
               booking_rooms=[("BR1", "BOOK00001", "101", None, None, Decimal("1")),
                              ("BR2", "BOOK00001", "102", None, None, Decimal("1"))],
               bookings_cancelled=[("BOOKCANCEL1", "BOOK00001", "CUST00001", "HOT00001", Decimal("1"), "a"),
                                   ("BOOKCANCEL2", "BOOK00001", "CUST00001", "HOT00001", Decimal("1"), "b")])
    intended = agg.booking_counts(fs.bookings()).collect()[0].total_bookings
    literal = agg.booking_counts_literal(fs.bookings(), fs.booking_rooms(), fs.bookings_cancelled()
                                         ).collect()[0].total_bookings
    assert intended == 2          # BOOK1 and the NULL-status BOOK3 pass "!== Cancelled"
    assert literal == 2 * 2 + 1   # BOOK1 x 2 rooms x 2 cancel rows, + BOOK3


def test_q11_latest_cancel_row_wins(spark):
    fs = world(spark, bookings_cancelled=[("BOOKCANCEL7", "BOOK00001", "C", "H", Decimal("1"), "first"),
                                          ("BOOKCANCEL12", "BOOK00001", "C", "H", Decimal("1"), "second")])
    r = agg.latest_cancel(fs.bookings_cancelled()).collect()[0]
    assert (r.cancel_reason, r.cancel_rows) == ("second", 2)


def _admin_world(spark):
    hotels = [hotel(i, city="Lyon" if i % 2 else "Nice", hours=i) for i in range(1, 15)]
    rooms = [room(i, i, "101", available=True) for i in range(1, 15)]
    return world(spark, hotels=hotels, rooms=rooms, customers=[customer(1)])


def test_q1_q2_admin_literal_filters_the_page_only(spark):
    fs = _admin_world(spark)
    a = HotelAnswers(fs)
    intended = a.hotel_admin_search(city="lyon").collect()
    literal = a.hotel_admin_search(city="lyon", mode="literal").collect()
    assert intended[0].total_hotels == 7      # all Lyon hotels
    assert literal[0].total_hotels == 5       # Lyon hotels among the newest 10
    assert a.hotel_admin_search(city="lyon", page_no=2, mode="literal").count() == 0
    assert a.hotel_admin_search(city="nice", page_no=1).count() == 7


def test_q9_city_search_orders_by_hotel_id(spark):
    fs = _admin_world(spark)
    rows = HotelAnswers(fs).hotel_search_city_country(city="", country="").collect()
    assert [r.page_pos for r in rows] == list(range(1, 11))
    assert [r.hotel_id for r in rows] == [f"HOT{i:05d}" for i in range(1, 11)]
    assert rows[0].total_hotels == 14 and rows[0].total_pages == 2


def test_q3_price_literal_ignores_range_without_rating(spark):
    fs = _admin_world(spark)
    a = HotelAnswers(fs)
    assert a.hotel_search_price_rating(min_price=500, max_price=900, min_rating=0).count() == 0
    assert a.hotel_search_price_rating(min_price=500, max_price=900, min_rating=0, mode="literal").count() == 10


def test_q8_cancel_frees_rooms_in_booking_hotel_only(spark):
    fs = world(spark, hotels=[hotel(1), hotel(2)], customers=[customer(1)],
               rooms=[room(1, 1, "101", available=False), room(2, 2, "101", available=False)],
               bookings=[booking(1, 1, 1)],
               booking_rooms=[("BR1", "BOOK00001", "101", None, None, Decimal("1"))],
               cancel_requests=[(1, "BOOK00001", "CUST00001", "HOT00001", "change of plans")])
    intended = cancel_bookings(fs).outputs["rooms_freed"].collect()
    literal = cancel_bookings(fs, literal_rooms=True).outputs["rooms_freed"].collect()
    assert [r.hotel_id for r in intended] == ["HOT00001"]
    assert sorted(r.hotel_id for r in literal) == ["HOT00001", "HOT00002"]


def test_q7_history_total_counts_bookings_without_hotel(spark):
    fs = world(spark, hotels=[hotel(1)], customers=[customer(1)],
               bookings=[booking(1, 1, 1), booking(2, 1, 9)])
    rows = HotelAnswers(fs).booking_history("CUST00001").collect()
    assert len(rows) == 1
    assert (rows[0].total_bookings, rows[0].total_listed) == (2, 1)


def test_q13_totals_given_on_empty_page(spark):
    fs = _admin_world(spark)
    a = HotelAnswers(fs)
    rows = a.hotel_directory(page_no=1).collect()
    assert all(r.total_hotels == 14 for r in rows)
    assert a.hotel_directory(page_no=3).count() == 0
    env = a.hotel_directory(page_no=3, envelope=True).collect()
    assert [(e.total_hotels, e.total_pages, e.current_page) for e in env] == [(14, 2, 3)]
    env = a.hotel_admin_search(city="lyon", page_no=5, envelope=True).first()
    assert (env.total_hotels, env.total_pages) == (7, 1)


def test_nan_rating_disables_filter(spark):
    fs = _admin_world(spark)
    assert HotelAnswers(fs).hotel_admin_search(ratings=float("nan"), envelope=True).first().total_hotels == 14


def test_q5_literal_booking_sort_has_no_effect(spark):
    hotels = [hotel(i, hours=i) for i in range(1, 5)]
    bookings = [booking(i, 1, 1 + i % 4) for i in range(1, 11)] + [booking(11, 1, 4), booking(12, 1, 4)]
    fs = world(spark, hotels=hotels, customers=[customer(1)], bookings=bookings)
    a = HotelAnswers(fs)
    lit = [r.hotel_id for r in a.hotel_admin_search(bookings_count="high to low", mode="literal").collect()]
    newest = [r.hotel_id for r in a.hotel_directory().collect()]
    assert lit == newest                        # the sort compared an undefined field
    intended = a.hotel_admin_search(bookings_count="high to low").collect()
    assert [r.total_bookings for r in intended] == sorted((r.total_bookings for r in intended), reverse=True)


def test_q6_literal_history_pages_room_rows(spark):
    bookings = [booking(i, 1, 1, hours=i) for i in range(1, 5)]
    br = [(f"BR{b}-{k}", f"BOOK{b:05d}", str(100 + k), None, None, Decimal("1")) for b in range(1, 5)
          for k in range(1, 5)]
    fs = world(spark, hotels=[hotel(1)], customers=[customer(1)], bookings=bookings, booking_rooms=br)
    a = HotelAnswers(fs)
    lit = a.booking_history_literal("CUST00001").collect()
    assert [(r.booking_id, r.n_room_entries) for r in lit] == [("BOOK00004", 4), ("BOOK00003", 4),
                                                                 ("BOOK00002", 2)]
    assert [r.booking_id for r in a.booking_history("CUST00001").collect()] == [
        "BOOK00004", "BOOK00003", "BOOK00002", "BOOK00001"]


def test_q10_hotels_with_rooms_newest_first(spark):
    fs = world(spark, hotels=[hotel(1, hours=1), hotel(2, hours=2), hotel(3, hours=3)],
               rooms=[room(1, 1, "101"), room(2, 1, "102"), room(3, 3, "101")])
    rows = HotelAnswers(fs).hotel_search_price_rating(min_price=0, max_price=1000).collect()
    assert [r.hotel_id for r in rows] == ["HOT00003", "HOT00001"]


def test_q12_roomless_booking_literal_entry(spark):
    from innkeep.registry import QUERIES, load_all
    load_all()
    fs = world(spark, hotels=[hotel(1)], customers=[customer(1)], bookings=[booking(1, 1, 1)])
    r = QUERIES["agg_nest_bookings"](fs).first()
    assert (r.n_rooms, r.n_room_entries_literal) == (0, 1)


def test_q11_q12_nested_booking_entries(spark):
    from innkeep.plans.documents import directory_documents
    fs = world(spark, hotels=[hotel(1)], customers=[customer(1)],
               bookings=[booking(1, 1, 1, hours=2), booking(2, 1, 1, hours=1)],
               booking_rooms=[("BR1", "BOOK00001", "101", None, None, Decimal("1")),
                              ("BR2", "BOOK00001", "102", None, None, Decimal("1"))],
               bookings_cancelled=[("BOOKCANCEL1", "BOOK00001", "CUST00001", "HOT00001", Decimal("1"), "a"),
                                   ("BOOKCANCEL2", "BOOK00001", "CUST00001", "HOT00001", Decimal("1"), "b")])
    intended = directory_documents(fs).first().bookings
    literal = directory_documents(fs, mode="literal").first().bookings
    assert [(e.booking_id, len(e.rooms), e.cancel_reason) for e in intended] == [("BOOK00001", 2, "b"),
                                                                                  ("BOOK00002", 0, None)]
    assert [(e.booking_id, len(e.rooms), e.cancel_reason) for e in literal] == [("BOOK00001", 4, "a"),
                                                                                ("BOOK00002", 1, None)]
    assert literal[1].rooms[0].room_number is None


def test_q6_literal_history_matches_brute_force_on_every_page(spark):
    """Bookings with several rooms and cancel rows, cut across pages: the
    arithmetic page equals the materialized fan-out sliced in Python."""
    import random
    rnd = random.Random(3)
    bookings = [booking(i, 1, 1 + i % 2, hours=rnd.randint(0, 5)) for i in range(1, 9)]
    br, bc = [], []
    for b in range(1, 9):
        for k in range(rnd.randint(0, 3)):
            br.append((f"BR{b}-{k}", f"BOOK{b:05d}", str(100 + k), None, None, Decimal("1")))
        for k in range(rnd.randint(0, 3)):
            bc.append((f"BOOKCANCEL{b}{k}", f"BOOK{b:05d}", "CUST00001", "HOT00001", Decimal("1"), f"r{b}.{k}"))
    fs = world(spark, hotels=[hotel(1), hotel(2)], customers=[customer(1)], bookings=bookings,
               booking_rooms=br, bookings_cancelled=bc)
    rows = []
    for b in sorted(bookings, key=lambda x: (-x[6].timestamp(), x[0])):
        rs = sorted(r[0] for r in br if r[1] == b[1]) or [None]
        cs = sorted((c for c in bc if c[1] == b[1]), key=lambda c: c[0]) or [None]
        rows += [(b[1], c[5] if c else None) for r in rs for c in cs]
    a = HotelAnswers(fs)
    for page_no in range(1, 5):
        chunk = rows[(page_no - 1) * 10: page_no * 10]
        want = {}
        for pos, (bid, reason) in enumerate(chunk, start=1):
            if bid not in want:
                want[bid] = [pos, 0, reason]
            want[bid][1] += 1
        got = {r.booking_id: [r.page_pos, r.n_room_entries, r.cancel_reason]
               for r in a.booking_history_literal("CUST00001", page_no).collect()}
        assert got == want, page_no
