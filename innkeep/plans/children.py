"""Children of the read answers as rows.

The service nests a page's rooms, services, reviews and bookings (each with
its rooms and cancel reasons) in arrays.  Here they are rows that carry their
place: ``page_pos`` of the hotel or booking on the page, ``pos`` in its array,
and for the second level ``booking_pos``.  A page has ten entries at most, but
one of them may own any number of children, so places come from a distributed
rank, never from collecting an array.

Every function takes the page (``page_pos`` and its key), which is computed
once (checkpointed) and then read by each child.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.functions.ids import digits_number
from innkeep.operators import aggregates as agg
from innkeep.operators.ranking import rank_within_groups
from innkeep.plans.directory import children, newest_first, semi_any
from innkeep.session import materialize


def _placed(rows: DataFrame, pg: DataFrame, on: str = "hotel_id") -> DataFrame:
    """``rows`` with the place of their hotel or booking on the page."""
    return rows.join(F.broadcast(pg.select("page_pos", on)), on)      # <= 10 rows


def _customer_names(fx) -> DataFrame:
    return fx.customers().select("customer_id", F.col("full_name").alias("customer_name"))


class PageChildren:
    """The children of one page of hotels (``page_pos``, ``hotel_id``) or of
    bookings (``page_pos``, ``booking_id``)."""

    def __init__(self, fx, pg: DataFrame, by_price: bool = False):
        self.fx = fx
        self.on = "hotel_id" if "hotel_id" in pg.columns else "booking_id"
        self.pg = materialize(pg.select("page_pos", self.on))
        self.by_price = by_price
        self._bookings: DataFrame | None = None

    # -- first level -----------------------------------------------------------
    def rooms(self) -> DataFrame:
        """In insertion order, or by price (NULLs first) for the price search."""
        order = [F.col("price_per_night").asc_nulls_first(), "id"] if self.by_price else ["id"]
        r = children(self.fx, "rooms", self.pg).select("id", "hotel_id", "room_number", "room_type", "price_per_night", "is_available")
        return _placed(rank_within_groups(r, ["hotel_id"], order), self.pg).select(
            "page_pos", "hotel_id", "pos", "room_number", "room_type", "price_per_night", "is_available")

    def services(self) -> DataFrame:
        s = children(self.fx, "services", self.pg).select("hotel_id", "service_id", "service_name", "service_charge")
        return _placed(rank_within_groups(s, ["hotel_id"], ["service_id"]), self.pg).select(
            "page_pos", "hotel_id", "pos", "service_id", "service_name", "service_charge")

    def reviews(self) -> DataFrame:
        r = children(self.fx, "reviews", self.pg).select("id", "hotel_id", "customer_id", "rating", "comment", "review_date")
        ranked = rank_within_groups(r, ["hotel_id"], ["id"])
        return (_placed(ranked, self.pg).join(_customer_names(self.fx), "customer_id", "left")
                .select("page_pos", "hotel_id", "pos", "customer_name", "rating", "comment", "review_date"))

    def bookings(self) -> DataFrame:
        """Newest first, with the latest cancel reason and the number of rooms."""
        b = self._ranked_bookings()
        latest = agg.latest_cancel(semi_any(self.fx.bookings_cancelled(), b, "booking_id")).select("booking_id", "cancel_reason")
        rooms = semi_any(self.fx.booking_rooms(), b, "booking_id").groupBy("booking_id").agg(F.count(F.lit(1)).alias("n_rooms"))
        return (b.join(latest, "booking_id", "left").join(rooms, "booking_id", "left").join(_customer_names(self.fx), "customer_id", "left")
                .select("page_pos", "hotel_id", "pos", "booking_id", "customer_name", F.col("booking_status").alias("status"),
                        "total_amount", "cancel_reason", F.coalesce("n_rooms", F.lit(0)).cast("long").alias("n_rooms")))

    def _ranked_bookings(self) -> DataFrame:
        if self._bookings is None:
            b = children(self.fx, "bookings", self.pg).select("id", "booking_id", "hotel_id", "customer_id", "booking_status", "total_amount", "created_at")
            self._bookings = materialize(_placed(rank_within_groups(b, ["hotel_id"], newest_first()), self.pg))
        return self._bookings

    # -- second level ------------------------------------------------------------
    def _of_bookings(self, name: str) -> DataFrame:
        """Rows of ``name`` with the place of their booking: through the
        ranked bookings of a page of hotels, or a page of bookings itself."""
        if self.on == "booking_id":
            return _placed(children(self.fx, name, self.pg, "booking_id"), self.pg, "booking_id")
        b = self._ranked_bookings().select("page_pos", "hotel_id", F.col("pos").alias("booking_pos"), "booking_id")
        rows = self.fx.table(name).drop("hotel_id")
        return rows.join(b, "booking_id")

    def _lead(self) -> list[str]:
        return ["page_pos", "hotel_id", "booking_pos", "booking_id"] if self.on == "hotel_id" else ["page_pos", "booking_id"]

    def booking_rooms(self) -> DataFrame:
        r = self._of_bookings("booking_rooms")
        return rank_within_groups(r, ["booking_id"], ["booking_room_id"]).select(
            *self._lead(), "pos", "room_number", "check_in", "check_out", "room_amount")

    def booking_cancels(self) -> DataFrame:
        """Every cancel row of a booking, oldest first (Q11: not the latest only)."""
        c = self._of_bookings("bookings_cancelled")
        return rank_within_groups(c, ["booking_id"], [digits_number(F.col("booking_cancel_id")), "booking_cancel_id"]).select(
            *self._lead(), "pos", "booking_cancel_id", "cancel_reason")
