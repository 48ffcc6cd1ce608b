"""Nested answer documents: a page of hotels with rooms, services, reviews
and bookings (each booking with its rooms) as ``ARRAY<STRUCT>`` columns.

Children are first reduced to the page's hotels by a broadcast left-semi
join (the page has at most 10 keys), then grouped; arrays are ordered by a
key so the document is deterministic.  The flat registered answers carry
the same information as counts and positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.operators import aggregates as agg
from innkeep.plans.directory import HotelAnswers, children, newest_hotels, semi_any


def _nest(df: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    s = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*fields).alias("v"))
    return (df.groupBy(key).agg(F.array_sort(F.collect_list(s)).alias("_a"))
            .select(key, F.transform("_a", lambda x: x["v"]).alias(name)))


def _attach(base: DataFrame, arr: DataFrame, key: str, name: str) -> DataFrame:
    empty = F.array().cast(arr.schema[name].dataType)
    return base.join(arr, key, "left").withColumn(name, F.coalesce(F.col(name), empty))


def booking_entries(fx, hotels: DataFrame, mode: str = "intended") -> DataFrame:
    """hotel_id, bookings: [{booking_id, customer_name, status, total_amount,
    cancel_reason, rooms: [...]}], newest first.

    intended: one cancel row per booking (the latest), an empty rooms list for
    a booking without rooms.  literal (quirks Q11/Q12): the booking's joined
    rows are its room entries, so every cancel row repeats the rooms and a
    booking without rooms gets one all-NULL room; the first row supplies the
    scalars."""
    b = children(fx, "bookings", hotels)
    cust = fx.customers().select("customer_id", F.col("full_name").alias("customer_name"))
    room_fields = ["room_number", "check_in", "check_out", "room_amount"]
    br = semi_any(fx.booking_rooms(), b, "booking_id")   # a hotel's bookings: unbounded
    rooms = _nest(br, "booking_id", ["booking_room_id"], room_fields, "rooms")
    cancels = semi_any(fx.bookings_cancelled(), b, "booking_id")
    if mode == "literal":
        # the chain's rows of a booking are its rooms x its cancel rows (rooms
        # in id order, each repeated once per cancel row); the first row's
        # cancel is the lowest cancel id.  Built with array functions inside
        # the booking's row, never by joining rooms to cancel rows.
        c = cancels.groupBy("booking_id").agg(F.count(F.lit(1)).alias("_nc"),
                                              F.min_by("cancel_reason", "booking_cancel_id").alias("cancel_reason"))
        elem = rooms.schema["rooms"].dataType.elementType
        null_room = F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in elem.fields]))
        entries = b.join(cust, "customer_id", "left").join(c, "booking_id", "left").join(rooms, "booking_id", "left")
        own = F.when(F.size(F.coalesce("rooms", F.array().cast(rooms.schema["rooms"].dataType))) > 0,
                     F.col("rooms")).otherwise(null_room)
        times = F.coalesce(F.col("_nc"), F.lit(1)).cast("int")
        entries = entries.withColumn("rooms", F.flatten(F.transform(own, lambda r: F.array_repeat(r, times))))
    else:
        bc = agg.latest_cancel(cancels).select("booking_id", "cancel_reason")
        entries = _attach(b.join(cust, "customer_id", "left").join(bc, "booking_id", "left"), rooms,
                          "booking_id", "rooms")
    entries = entries.withColumn("_neg_ts", -F.unix_micros(F.col("created_at").cast("timestamp")))
    return _nest(entries, "hotel_id", ["_neg_ts", "id"],
                 ["booking_id", "customer_name", F.col("booking_status").alias("status"), "total_amount",
                  "cancel_reason", "rooms"], "bookings")


def page_documents(fx, cards: DataFrame, bookings: bool = True, rooms_by_price: bool = False,
                   mode: str = "intended") -> DataFrame:
    """Nest the children of a page of hotel cards (any answer's page: at most
    10 hotels, which bounds the broadcast of its keys)."""
    cust = fx.customers().select("customer_id", F.col("full_name").alias("customer_name"))
    room_order = [F.col("price_per_night").isNotNull(), "price_per_night", "id"] if rooms_by_price else ["id"]
    rooms = _nest(children(fx, "rooms", cards), "hotel_id", room_order,
                  ["room_number", "room_type", "price_per_night", "is_available"], "rooms")
    services = _nest(children(fx, "services", cards), "hotel_id", ["service_id"],
                     ["service_id", "service_name", "service_charge"], "services")
    reviews = _nest(children(fx, "reviews", cards).join(cust, "customer_id", "left"), "hotel_id", ["id"],
                    ["customer_name", "rating", "comment", "review_date"], "reviews")
    doc = cards
    parts = [(rooms, "rooms"), (services, "services"), (reviews, "reviews")]
    if bookings:
        parts.append((booking_entries(fx, cards, mode), "bookings"))
    for arr, name in parts:
        doc = _attach(doc, arr, "hotel_id", name)
    return doc.drop("id")


def directory_documents(fx, page_no: int = 1, mode: str = "intended") -> DataFrame:
    cards = HotelAnswers(fx)._enrich(newest_hotels(fx, page_no), bookings=True, price=False, mode=mode)
    return page_documents(fx, cards, bookings=True, mode=mode)
