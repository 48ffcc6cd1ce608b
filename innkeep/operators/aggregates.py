"""Per-hotel aggregates shared by the directory and search plans.

Each is a ``groupBy(hotel_id)`` whose partial aggregation runs map-side, so a
hotel holding a large share of the rows is pre-combined before the shuffle.

Rounding follows the SQL engine the reference runs on: ``AVG`` of an
``INT``/``DECIMAL(10,2)`` column is a decimal with four more fractional
digits, and ``ROUND(.., 2)`` rounds that half away from zero.  Spark's
decimal ``avg`` has the same result type and rounding, so the averages are
taken on decimals, never on doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def review_summary(reviews: DataFrame) -> DataFrame:
    """hotel_id, avg_rating = ROUND(AVG(rating), 2), total_reviews = COUNT(*)."""
    return reviews.groupBy("hotel_id").agg(
        F.round(F.avg(F.col("rating").cast("decimal(10,0)")), 2).alias("avg_rating"),
        F.count(F.lit(1)).alias("total_reviews"),
    )


def avg_price(rooms: DataFrame) -> DataFrame:
    """hotel_id, avg_price_per_night = ROUND(AVG(price_per_night), 2); NULL
    prices are skipped, a hotel whose prices are all NULL gets NULL."""
    return rooms.groupBy("hotel_id").agg(
        F.round(F.avg("price_per_night"), 2).alias("avg_price_per_night"))


def available_rooms(rooms: DataFrame) -> DataFrame:
    """hotel_id, total_rooms_available = number of rooms with is_available."""
    return rooms.groupBy("hotel_id").agg(
        F.count_if(F.col("is_available")).alias("total_rooms_available"))


def room_stats(rooms: DataFrame) -> DataFrame:
    """One pass over rooms for everything the search pages need: room count,
    available count and average price."""
    return rooms.groupBy("hotel_id").agg(
        F.count(F.lit(1)).alias("room_count"),
        F.count_if(F.col("is_available")).alias("total_rooms_available"),
        F.round(F.avg("price_per_night"), 2).alias("avg_price_per_night"),
    )


def not_cancelled(status_col="booking_status"):
    """``booking_status !== "Cancelled"``: NULL passes, case-sensitive."""
    return ~F.col(status_col).eqNullSafe(F.lit("Cancelled"))


def booking_counts(bookings: DataFrame) -> DataFrame:
    """Intended booking count: distinct non-cancelled bookings per hotel.
    booking_id is unique in bookings, so a plain count is distinct."""
    return (bookings.where(not_cancelled())
            .groupBy("hotel_id")
            .agg(F.count(F.lit(1)).alias("total_bookings")))


def booking_chain(bookings: DataFrame, customers: DataFrame, booking_rooms: DataFrame,
                  cancelled: DataFrame) -> DataFrame:
    """bookings LEFT JOIN customers LEFT JOIN booking_rooms LEFT JOIN
    bookings_cancelled without the product of a booking's rooms and cancel
    rows: one ``room`` row per (booking, room), also for a booking without
    rooms, and one ``cancel`` row per (booking, cancel row), so every reason
    is kept.  ``part_id`` names the room or cancel row, ``chain_rows`` counts
    the rows of the full chain the row stands for (at least 1)."""
    head = bookings.join(customers.select("customer_id", F.col("full_name").alias("customer_name")), "customer_id", "left")
    rooms = booking_rooms.select("booking_id", "room_number", "check_in", "check_out", "room_amount",
                                 F.col("booking_room_id").alias("part_id"))
    cancels = cancelled.select("booking_id", "cancel_reason", F.col("booking_cancel_id").alias("part_id"))

    def per_booking(df):
        return df.groupBy("booking_id").agg(F.count(F.lit(1)).alias("chain_rows"))

    by_room = (head.join(rooms, "booking_id", "left").join(per_booking(cancels), "booking_id", "left")
               .withColumn("kind", F.lit("room")))
    by_cancel = (head.join(cancels, "booking_id").join(per_booking(rooms), "booking_id", "left")
                 .withColumn("kind", F.lit("cancel")))
    return (by_room.unionByName(by_cancel, allowMissingColumns=True)
            .withColumn("chain_rows", F.coalesce("chain_rows", F.lit(1)).cast("long")))


def booking_multiplicity(bookings: DataFrame, booking_rooms: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Per booking, how many rows the reference's chain join (booking x its
    rooms x its cancel rows) gives it: max(rooms, 1) * max(cancel rows, 1).
    Counted from per-booking pre-aggregates, so the product of a booking's
    rooms and cancel rows is never materialized."""
    nr = booking_rooms.groupBy("booking_id").agg(F.count(F.lit(1)).alias("_nr"))
    nc = cancelled.groupBy("booking_id").agg(F.count(F.lit(1)).alias("_nc"))
    return (bookings.join(nr, "booking_id", "left").join(nc, "booking_id", "left")
            .withColumn("chain_rows", (F.coalesce("_nr", F.lit(1)) * F.coalesce("_nc", F.lit(1))).cast("long"))
            .drop("_nr", "_nc"))


def booking_counts_literal(bookings: DataFrame, booking_rooms: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Literal booking count (quirk Q4): joined rows whose status is not
    Cancelled, so a booking counts once per room x cancel row; computed as a
    sum of per-booking multiplicities, not by emitting the joined rows."""
    return (booking_multiplicity(bookings.where(not_cancelled()), booking_rooms, cancelled)
            .groupBy("hotel_id")
            .agg(F.sum("chain_rows").cast("long").alias("total_bookings")))


def latest_cancel(cancelled: DataFrame) -> DataFrame:
    """One cancel row per booking: the one with the highest id suffix (the
    latest insert).  ``max_by`` is a partial aggregate, safe under skew."""
    from innkeep.functions.ids import digits_number
    return (cancelled
            .withColumn("_k", digits_number(F.col("booking_cancel_id")))
            .groupBy("booking_id")
            .agg(F.max_by("cancel_reason", "_k").alias("cancel_reason"),
                 F.count(F.lit(1)).alias("cancel_rows")))
