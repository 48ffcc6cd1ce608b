"""Stored tables: pruned page reads, pages by rank, partial rewrites, defaults;
the same answers as over the derived tables."""

import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from innkeep.operators.ranking import prefix_sums
from innkeep.oracle.compare import _rows
from innkeep.plans.children import PageChildren
from innkeep.plans.directory import HotelAnswers, children, newest_first, newest_hotels
from innkeep.plans.fragments import document_entries, fragment_entries, fragments, write_fragments
from innkeep.queries import composites as C
from innkeep.session import staging_path
from innkeep.sources.ddl import create_tables, insert_rows
from innkeep.sources.layout import BUCKET, CatalogTables, publish_tables, ranked_in_ranges, ranked_page
from innkeep.sources.updates import StoredTable
from tests.world import T0, booking, customer, hotel, room, world


@pytest.fixture(scope="module")
def stored(spark, fx):
    publish_tables(fx, "lodging_pruned", buckets=8, range_rows=20)
    return CatalogTables(spark, "lodging_pruned", base=fx)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scanned_partitions(df) -> int:
    """How many partitions the scan of a stored table has read, from its
    metrics, as the sum over the plan's partitioned scans but the ranked one."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec" and "_bucket" in node.toString().split("PartitionFilters")[1].split("]")[0]:
            found += node.metrics().apply("numPartitions").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return found


def same(a, b):
    assert _rows(a.columns, a.collect()) == _rows(b.columns, b.collect())


def test_no_row_of_part_or_events_is_left_out(fx):
    assert fx.rooms().count() == fx.t.part.count() and fx.reviews().count() == fx.t.events.count()
    assert fx.rooms().groupBy("hotel_id", "room_number").count().filter("count > 1").count() == 0
    hotels = fx.hotels().select("hotel_id")
    assert fx.reviews().join(hotels, "hotel_id", "left_anti").count() == 0
    assert hotels.join(fx.reviews(), "hotel_id", "left_anti").count() > 0


def test_the_five_answers_on_stored_tables(fx, stored):
    own, kept = HotelAnswers(fx), HotelAnswers(stored)
    cust = fx.bookings().groupBy("customer_id").count().orderBy(F.desc("count"), "customer_id").first().customer_id
    for ask in (lambda a: a.hotel_directory(1), lambda a: a.hotel_directory(1, mode="literal"), lambda a: a.hotel_admin_search(ratings=1.0),
                lambda a: a.hotel_search_city_country(city="nation", country=""), lambda a: a.hotel_search_price_rating(100, 2000, 1),
                lambda a: a.booking_history(cust, 1), lambda a: a.booking_history(cust, 2), lambda a: a.booking_history("nobody", 1),
                lambda a: a.booking_history_literal(cust, 2), lambda a: a.hotel_directory(99)):
        same(ask(own), ask(kept))


def test_page_reads_prune_partitions(stored):
    pg = newest_hotels(stored, 1)
    assert "PartitionFilters: [isnotnull(_range" in plan(pg).replace("PartitionFilters: [_range", "PartitionFilters: [isnotnull(_range")
    for name in ("rooms", "reviews", "services", "bookings"):
        df = children(stored, name, pg.where("page_pos <= 2"))
        text = plan(df)
        assert "dynamicpruning" in text.lower(), text
        df.collect()
        assert scanned_partitions(df) <= 2 < stored.spark.table(f"lodging_pruned.{name}").select(BUCKET).distinct().count()
    mine = stored.bookings_of("CUST00007")
    assert "PartitionFilters: [isnotnull(_bucket" in plan(mine).replace("PartitionFilters: [(_bucket", "PartitionFilters: [isnotnull(_bucket")
    answer = plan(HotelAnswers(stored).hotel_directory(1))
    assert answer.lower().count("dynamicpruning") >= 4


def test_a_far_page_reads_one_range(spark, fx):
    path = staging_path(spark, f"ranked-{uuid.uuid4()}")
    ranked_in_ranges(fx.bookings(), newest_first(), range_rows=50).write.partitionBy("_range").parquet(path)
    table = spark.read.parquet(path)
    want = [r.booking_id for r in fx.bookings().orderBy(*newest_first()).collect()]
    for n in (1, 5, 6, 97, 150):
        got = ranked_page(table, n, range_rows=50)
        assert len(got.inputFiles()) >= 1 and got.select(F.input_file_name()).distinct().count() <= 1 + (n == 150)
        assert [r.booking_id for r in got.orderBy("page_pos").collect()] == want[10 * (n - 1):10 * n]
        files = {r[0].split("_range=")[1].split("/")[0] for r in got.select(F.input_file_name()).distinct().collect()}
        assert files == {str((n - 1) * 10 // 50)}
    assert ranked_page(table, 10_000, range_rows=50).count() == 0
    with pytest.raises(ValueError):
        ranked_page(table, 0, range_rows=50)
    with pytest.raises(ValueError):
        ranked_in_ranges(fx.bookings(), newest_first(), range_rows=55)


def test_update_rewrites_touched_partitions_only(spark, fx):
    t = StoredTable.create(fx.bookings(), staging_path(spark, f"upd-{uuid.uuid4()}"), "hotel_id", "booking_id", 8)
    before = set(spark.read.parquet(t.path).inputFiles())
    change = spark.createDataFrame([("HOT00003", "BOOK00003", "Cancelled"), ("HOT00003", "BOOK99999", "Cancelled")], "hotel_id string, booking_id string, booking_status string")
    t.update(change, ["hotel_id", "booking_id"], {"booking_status": F.col("booking_status")}, "2024-05-06")
    after = set(spark.read.parquet(t.path).inputFiles())
    gone = {f.split(f"{BUCKET}=")[1].split("/")[0] for f in before - after}
    assert len(gone) == 1 and len(before & after) > 0
    rows = {r.booking_id: r for r in t.read().collect()}
    assert len(rows) == fx.bookings().count()
    assert rows["BOOK00003"].booking_status == "Cancelled" and rows["BOOK00003"].updated_at == dt.datetime(2024, 5, 6)
    others = fx.bookings().filter("booking_id <> 'BOOK00003'")
    same(others, t.read().filter("booking_id <> 'BOOK00003'").drop("updated_at"))
    assert t.read().filter("updated_at is not null").count() == 1
    t.update(change.limit(0), ["hotel_id", "booking_id"], {"booking_status": F.col("booking_status")}, "2024-05-07")
    assert set(spark.read.parquet(t.path).inputFiles()) == after
    t.append(fx.bookings().limit(3))
    assert t.read().count() == fx.bookings().count() + 3 and after <= set(spark.read.parquet(t.path).inputFiles())
    with pytest.raises(ValueError):
        t.update(change, ["booking_id"], {"booking_status": F.col("booking_status")}, "2024-05-07")


def test_update_can_set_null(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, id long, v string")
    t = StoredTable.create(df, staging_path(spark, f"upd-{uuid.uuid4()}"), "k", "id", 4)
    t.update(spark.createDataFrame([("a", None)], "k string, v string"), ["k"], {"v": F.col("v")}, "2024-05-06")
    assert {r.k: (r.v, r.updated_at is not None) for r in t.read().collect()} == {"a": (None, True), "b": ("y", False)}


def test_inserts_get_the_table_defaults(spark):
    name = uuid.uuid4().hex
    create_tables(spark, f"defaults_{name}", staging_path(spark, name), names=("rooms", "bookings"))
    insert_rows(spark, f"defaults_{name}", "rooms", spark.createDataFrame([(1, "ROOM00001", "HOT00001", "1")], "id long, room_id string, hotel_id string, room_number string"))
    insert_rows(spark, f"defaults_{name}", "rooms", spark.createDataFrame([("ROOM00002", "Suite", False)], "room_id string, room_type string, is_available boolean"))
    rows = {r.room_id: r for r in spark.table(f"defaults_{name}.rooms").collect()}
    assert (rows["ROOM00001"].room_type, rows["ROOM00001"].is_available) == ("Standard", True)
    assert (rows["ROOM00002"].room_type, rows["ROOM00002"].is_available, rows["ROOM00002"].hotel_id) == ("Suite", False, None)
    assert abs((rows["ROOM00001"].created_at - dt.datetime.now(dt.UTC).replace(tzinfo=None)).total_seconds()) < 600
    spark.sql(f"DROP DATABASE defaults_{name} CASCADE")


def test_prefix_sums_within_hot_groups(spark):
    rows = [("hot", i, i % 7) for i in range(3000)] + [(f"g{i % 50}", i, 1) for i in range(500)] + [(None, i, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    got = {(r.k, r.i): r.before for r in prefix_sums(df, ["k"], ["i"], "v").collect()}
    want, sums = {}, {}
    for k, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        want[k, i] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    assert got == want
    assert prefix_sums(df.limit(0), ["k"], ["i"], "v").count() == 0


# -- children and documents -----------------------------------------------------------
def hand_world(spark):
    rooms = [room(1, 1, "101", price=None), room(2, 1, "102", price="50.00"), room(3, 1, "103", price="10.00"), room(4, 2, "101")]
    bookings = [booking(1, 1, 1, hours=1), booking(2, 9, 1, status=None, hours=2), booking(3, 1, 3)]
    br = [("BR1-1", "BOOK00001", "101", dt.date(2024, 1, 1), dt.date(2024, 1, 3), None), ("BR1-2", "BOOK00001", "102", None, None, None)]
    cancels = [("BOOKCANCEL10", "BOOK00001", "CUST00001", "HOT00001", None, "second"), ("BOOKCANCEL9", "BOOK00001", "CUST00001", "HOT00001", None, 'first "one"')]
    reviews = [(2, "REV00002", "HOT00001", "CUST00009", 4, None, None), (1, "REV00001", "HOT00001", "CUST00001", 5, "fine", dt.date(2024, 1, 2))]
    return world(spark, hotels=[hotel(i, hours=-i) for i in (1, 2, 3, 4)], rooms=rooms, bookings=bookings, booking_rooms=br,
                 bookings_cancelled=cancels, reviews=reviews, customers=[customer(1)])


def test_children_of_a_page(spark):
    w = hand_world(spark)
    kids = PageChildren(w, HotelAnswers(w).directory_page(1))
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert [r[:4] for r in got(kids.rooms())] == [(1, "HOT00001", 1, "101"), (1, "HOT00001", 2, "102"), (1, "HOT00001", 3, "103"), (2, "HOT00002", 1, "101")]
    assert [(r.pos, r.room_number) for r in PageChildren(w, HotelAnswers(w).directory_page(1), by_price=True).rooms().filter("hotel_id = 'HOT00001'").orderBy("pos").collect()] \
        == [(1, "101"), (2, "103"), (3, "102")]
    assert got(kids.reviews()) == [(1, "HOT00001", 1, "Customer 1", 5, "fine", dt.date(2024, 1, 2)), (1, "HOT00001", 2, None, 4, None, None)]
    assert [(r.pos, r.booking_id, r.customer_name, r.status, r.cancel_reason, r.n_rooms) for r in kids.bookings().filter("hotel_id = 'HOT00001'").orderBy("pos").collect()] \
        == [(1, "BOOK00002", None, None, None, 0), (2, "BOOK00001", "Customer 1", "Confirmed", "second", 2)]
    assert [(r.booking_pos, r.booking_id, r.pos, r.room_number) for r in kids.booking_rooms().orderBy("pos").collect()] == [(2, "BOOK00001", 1, "101"), (2, "BOOK00001", 2, "102")]
    assert [(r.booking_pos, r.pos, r.cancel_reason) for r in kids.booking_cancels().orderBy("pos").collect()] == [(2, 1, 'first "one"'), (2, 2, "second")]
    assert kids.services().count() == 0
    history = PageChildren(w, HotelAnswers(w).history_bookings("CUST00001"))
    assert [(r.page_pos, r.booking_id, r.pos, r.cancel_reason) for r in history.booking_cancels().orderBy("pos").collect()] == [(1, "BOOK00001", 1, 'first "one"'), (1, "BOOK00001", 2, "second")]
    assert history.booking_rooms().count() == 2
    nobody = PageChildren(w, HotelAnswers(w).history_bookings("CUST77777"))
    assert nobody.booking_rooms().count() == 0 and nobody.booking_cancels().count() == 0


def test_fragments_are_bounded_and_whole(spark, fx, tmp_path):
    entries = document_entries(fx, C.DIRECTORY_PAGE)
    biggest = entries.select(F.max(F.octet_length("entry"))).first()[0]
    cut = fragment_entries(entries, 4000).cache()
    sizes = cut.groupBy("hotel_id", "fragment").agg(F.sum("bytes").alias("b")).collect()
    assert max(s.b for s in sizes) <= 4000 + biggest and len(sizes) > 20
    numbers = {}
    for s in sizes:
        numbers.setdefault(s.hotel_id, set()).add(s.fragment)
    assert all(0 in n and max(n) <= sum(s.b for s in sizes if s.hotel_id == h) // 4000 for h, n in numbers.items())
    whole = {}
    for r in fragments(cut).orderBy("hotel_id", "fragment").collect():
        doc = json.loads(r.document)
        assert doc["hotel_id"] == r.hotel_id and doc["fragment"] == r.fragment
        for section, items in doc.items():
            if isinstance(items, list):
                whole.setdefault((r.hotel_id, section), []).extend(items)
    rooms = fx.rooms().filter("hotel_id = 'HOT00001'").orderBy("id").collect()
    assert [x["room_number"] for x in whole["HOT00001", "rooms"]] == [r.room_number for r in rooms]
    write_fragments(hand_world(spark), f"{tmp_path}/documents", 1, 100)
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/documents").collect()]
    assert {d["hotel_id"] for d in lines} == {"HOT00001", "HOT00002", "HOT00003", "HOT00004"} and len(lines) > 4
    assert [c["cancel_reason"] for d in sorted(lines, key=lambda d: d["fragment"]) for c in d.get("booking_cancels", [])] == ['first "one"', "second"]
    assert T0.year == 2024
