"""The five read answers: hotel directory, admin search, the two customer
searches and a customer's booking history.

Two plan shapes are used:

* **page first** (directory, city/country search): the page of hotel keys is
  a top-k (TakeOrderedAndProject, <= 10 rows), broadcast into left-semi joins
  that reduce each child table to the page's rows before any aggregation.
* **filter first** (admin search, price/rating search): the filters read
  per-hotel aggregates, so those are computed for all hotels (partial
  aggregation, one shuffle each on hotel_id) and joined to hotels; then sort
  and page.

Every answer is a DataFrame of flat rows (one per hotel or booking on the
page) carrying the page totals as scalar-subquery columns; the nested form
(rooms/services/reviews/bookings arrays) is built by
:mod:`innkeep.plans.documents`.  ``mode="literal"`` reproduces the
reference's observable quirks (SURVEY 2.13) where they differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innkeep.operators import aggregates as agg
from innkeep.operators.filters import contains_ci, like_ci, unique_keys
from innkeep.operators.ranking import PAGE_SIZE, page, page_count, rank_within_groups
from innkeep.session import materialize
from innkeep.sources.fixtures import Fixtures
from innkeep.sources.layout import newest_first

HOTEL_COLS = ["id", "hotel_id", "hotel_name", "city", "country", "total_rooms", "created_at"]


def ts_text(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def as_double(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("double")


def in_page_order(df: DataFrame) -> DataFrame:
    """Return a page (at most PAGE_SIZE rows) in page order: one small local
    sort, no global sort job."""
    if "page_pos" not in df.columns:
        return df
    return df.coalesce(1).sortWithinPartitions("page_pos")


def semi(df: DataFrame, page_keys: DataFrame, on: str = "hotel_id") -> DataFrame:
    """``WHERE hotel_id IN (page ids)``.  Only for a page (<= 10 rows): that
    bound is what makes the broadcast safe."""
    return df.join(F.broadcast(page_keys.select(on).distinct()), on, "left_semi")


def _stored(fx, what: str, *args):
    """What a provider of stored tables has a shorter way for, else None."""
    return getattr(fx, what)(*args) if hasattr(type(fx), what) else None


def children(fx, name: str, page_keys: DataFrame, on: str = "hotel_id") -> DataFrame:
    """The rows of table ``name`` of a page's keys (<= 10).  Stored tables
    partitioned by the key read the partitions of these keys only."""
    found = _stored(fx, "children_of", name, page_keys, on)
    return semi(fx.table(name), page_keys, on) if found is None else found


def newest_hotels(fx, page_no: int) -> DataFrame:
    """A page of the hotels, newest first, with ``page_pos``.  Stored tables
    read the one range of ranks the page is in; others keep the first
    ``page_no`` pages of every partition."""
    found = _stored(fx, "hotels_page", page_no)
    return page(fx.hotels().select(*HOTEL_COLS), newest_first(), page_no) if found is None else found.select(*HOTEL_COLS, "page_pos")


def customer_bookings(fx, customer_id: str) -> DataFrame:
    found = _stored(fx, "bookings_of", customer_id)
    return fx.bookings().where(F.col("customer_id") == F.lit(customer_id)) if found is None else found


def history_page(listed: DataFrame, page_no: int) -> DataFrame:
    """A page of a customer's listed bookings, by their stored ranks where
    there are any."""
    if "_rank" not in listed.columns:
        return page(listed, newest_first(), page_no)
    if page_no < 1:
        raise ValueError("page must be >= 1")
    before = (page_no - 1) * PAGE_SIZE
    return (listed.where(F.col("_rank").between(before + 1, before + PAGE_SIZE))
            .withColumn("page_pos", F.col("_rank") - before).drop("_rank"))


def semi_any(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Left-semi join on a key set of unknown size: no hint, AQE chooses
    broadcast or shuffle from the measured size, and splits a hot key."""
    return df.join(unique_keys(keys, [on]), on, "left_semi")


class HotelAnswers:
    """Builds the read answers over one set of fixture tables."""

    def __init__(self, fx: Fixtures):
        self.fx = fx

    # -- shared enrichment ---------------------------------------------------
    def _enrich(self, hotels: DataFrame, *, bookings: bool, price: bool,
                mode: str = "intended", restrict: bool = True) -> DataFrame:
        """Left-join the per-hotel aggregates onto ``hotels`` (missing -> 0).

        ``restrict``: True reduces the child tables to ``hotels``' keys by a
        broadcast (a page); "any" by an unhinted semi-join (a filtered set of
        unknown size); False aggregates every hotel."""
        fx = self.fx
        if restrict in (False, "any"):
            rooms, reviews, services = fx.rooms(), fx.reviews(), fx.services()
        if restrict == "any":
            # a filtered hotel set of unknown size: reduce the children to it
            # before aggregating; AQE broadcasts the keys when they are few
            rooms, reviews, services = (semi_any(rooms, hotels, "hotel_id"), semi_any(reviews, hotels, "hotel_id"),
                                        semi_any(services, hotels, "hotel_id"))
        elif restrict:
            rooms, reviews, services = (children(fx, name, hotels) for name in ("rooms", "reviews", "services"))
        out = (hotels
               .join(agg.room_stats(rooms), "hotel_id", "left")
               .join(agg.review_summary(reviews), "hotel_id", "left")
               .join(services.groupBy("hotel_id").agg(F.count(F.lit(1)).alias("n_services")),
                     "hotel_id", "left"))
        out = out.select(
            *hotels.columns,
            F.coalesce("total_rooms_available", F.lit(0)).cast("long").alias("total_rooms_available"),
            F.coalesce("avg_rating", F.lit(0)).alias("average_rating"),
            F.coalesce("total_reviews", F.lit(0)).cast("long").alias("total_reviews"),
            F.coalesce("room_count", F.lit(0)).cast("long").alias("n_rooms"),
            F.coalesce("n_services", F.lit(0)).cast("long").alias("n_services"),
            *([F.coalesce("avg_price_per_night", F.lit(0)).alias("average_price_per_night")]
              if price else []),
        )
        if bookings:
            if restrict == "any":
                b = semi_any(fx.bookings(), hotels, "hotel_id")
            else:
                b = children(fx, "bookings", hotels) if restrict else fx.bookings()
            # one aggregation gives the listed bookings and the intended count
            listed = b.groupBy("hotel_id").agg(F.count(F.lit(1)).alias("n_bookings"),
                                               F.count_if(agg.not_cancelled()).alias("total_bookings"))
            if mode == "literal":
                counts = agg.booking_counts_literal(b, semi_any(fx.booking_rooms(), b, "booking_id"),
                                                    semi_any(fx.bookings_cancelled(), b, "booking_id"))
                listed = listed.drop("total_bookings").join(counts, "hotel_id", "left")
            out = (out.join(listed, "hotel_id", "left")
                   .withColumn("total_bookings", F.coalesce("total_bookings", F.lit(0)).cast("long"))
                   .withColumn("n_bookings", F.coalesce("n_bookings", F.lit(0)).cast("long")))
        return out

    def _envelope(self, totals: dict[str, Column], page_no: int) -> DataFrame:
        """One row with the page's totals, present even when the page is
        empty (quirk Q13, intended).  The totals are scalar subqueries over
        the tables; the one-row frame only carries them."""
        return self.fx.spark.range(1).select(
            *[v.alias(k) for k, v in totals.items()], F.lit(page_no).cast("int").alias("current_page"))

    @staticmethod
    def _flat(cards: DataFrame, totals: dict[str, Column], page_no: int) -> DataFrame:
        cols = []
        for c in cards.columns:
            if c == "id":
                continue
            if c == "created_at":
                cols.append(ts_text(c).alias(c))
            elif c in ("average_rating", "average_price_per_night"):
                cols.append(as_double(c).alias(c))
            else:
                cols.append(F.col(c))
        cols += [v.alias(k) for k, v in totals.items()]
        cols.append(F.lit(page_no).cast("int").alias("current_page"))
        return in_page_order(cards.select(*cols))

    # -- hotel directory (GET /get-all-hotels) ---------------------------------
    def hotel_directory(self, page_no: int = 1, mode: str = "intended", envelope: bool = False) -> DataFrame:
        hotels = self.fx.hotels().select(*HOTEL_COLS)
        total = hotels.select(F.count(F.lit(1))).scalar()
        totals = {"total_hotels": total, "total_pages": page_count(total)}
        if envelope:
            return self._envelope(totals, page_no)
        cards = self._enrich(newest_hotels(self.fx, page_no), bookings=True, price=False, mode=mode)
        return self._flat(cards, totals, page_no)

    # -- admin search (GET /filter-hotels) -------------------------------------
    def hotel_admin_search(self, city: str = "", country: str = "", ratings: float = 0.0,
                           sort_availability: str = "", bookings_count: str = "",
                           page_no: int = 1, mode: str = "intended", envelope: bool = False) -> DataFrame:
        city, country = (city or "").lower(), (country or "").lower()
        sort_availability = (sort_availability or "").lower()
        bookings_count = (bookings_count or "").lower()
        hotels = self.fx.hotels().select(*HOTEL_COLS)
        if mode == "literal":
            # Q1: the page is taken first, filters and sorts apply to it.
            base = page(hotels, newest_first(), page_no, pos_col="_newest")
            cards = self._enrich(base, bookings=True, price=False, mode=mode)
        else:
            base = hotels
            if city:
                base = base.where(contains_ci("city", city))
            if country:
                base = base.where(contains_ci("country", country))
            cards = self._enrich(base, bookings=True, price=False, mode=mode,
                                 restrict="any" if (city or country) else False)
        if mode == "literal":
            if city:
                cards = cards.where(contains_ci("city", city))
            if country:
                cards = cards.where(contains_ci("country", country))
        if ratings and ratings == ratings:          # JS: 0 and NaN disable the filter
            cards = cards.where(F.col("average_rating") >= F.lit(ratings))
        cards = materialize(cards)  # read by the page and by its total
        order: list[Column] = []
        # JS sorts are stable: the last applied sort is the primary key.
        if mode != "literal" and bookings_count in ("low to high", "high to low"):
            o = F.col("total_bookings")
            order.append(o.asc() if bookings_count == "low to high" else o.desc())
        if sort_availability in ("low to high", "high to low"):
            o = F.col("total_rooms_available")
            order.append(o.asc() if sort_availability == "low to high" else o.desc())
        order += newest_first()
        total = cards.select(F.count(F.lit(1))).scalar()
        totals = {"total_hotels": total, "total_pages": page_count(total)}
        if envelope:
            return self._envelope(totals, page_no)
        if mode == "literal":
            out = page(cards.drop("_newest"), order, 1) if page_no == 1 else \
                cards.drop("_newest").limit(0).withColumn("page_pos", F.lit(None).cast("long"))
        else:
            out = page(cards, order, page_no)
        return self._flat(out, totals, page_no)

    # -- customer city/country search -----------------------------------------
    def hotel_search_city_country(self, city: str = "", country: str = "", page_no: int = 1,
                                  mode: str = "intended", envelope: bool = False) -> DataFrame:
        city, country = (city or "").lower(), (country or "").lower()
        hotels = (self.fx.hotels().select(*HOTEL_COLS)
                  .where(like_ci("city", city) & like_ci("country", country)))
        total = hotels.select(F.count(F.lit(1))).scalar()
        totals = {"total_hotels": total, "total_pages": page_count(total)}
        if envelope:
            return self._envelope(totals, page_no)
        # Q9: the reference gives no order; a table scan returns it in
        # surrogate-id order (literal); intended pages by hotel_id
        order = [F.col("id").asc()] if mode == "literal" else [F.col("hotel_id").asc(), F.col("id").asc()]
        pg = page(hotels, order, page_no)
        cards = self._enrich(pg, bookings=False, price=True).drop("created_at")
        return self._flat(cards, totals, page_no)

    # -- customer price / rating search ---------------------------------------
    def hotel_search_price_rating(self, min_price: float = 0.0, max_price: float = 100000.0,
                                  min_rating: float = 0.0, page_no: int = 1,
                                  mode: str = "intended", envelope: bool = False) -> DataFrame:
        fx = self.fx
        with_rooms = fx.hotels().select(*HOTEL_COLS).join(fx.rooms().select("hotel_id").distinct(),
                                                           "hotel_id", "left_semi")
        if mode == "literal":
            pg = page(with_rooms, newest_first(), page_no, pos_col=None)
            cards = self._enrich(pg, bookings=False, price=True)
            if min_price >= 0 and max_price and min_rating and min_rating == min_rating:      # Q3
                cards = cards.where(self._price_rating_pred(min_price, max_price, min_rating))
            total = cards.select(F.count(F.lit(1))).scalar()
            out = page(cards, newest_first(), 1) if page_no == 1 else \
                cards.limit(0).withColumn("page_pos", F.lit(None).cast("long"))  # Q2
        else:
            cards = self._enrich(with_rooms, bookings=False, price=True, restrict=False)
            cards = materialize(cards.where(self._price_rating_pred(min_price, max_price, min_rating)))
            total = cards.select(F.count(F.lit(1))).scalar()
            out = page(cards, newest_first(), page_no)
        totals = {"total_hotels": total, "total_pages": page_count(total)}
        if envelope:
            return self._envelope(totals, page_no)
        return self._flat(out.drop("created_at"), totals, page_no)

    @staticmethod
    def _price_rating_pred(min_price: float, max_price: float, min_rating: float) -> Column:
        price = F.col("average_price_per_night")
        return (price.between(F.lit(min_price), F.lit(max_price))
                & (F.col("average_rating") >= F.lit(min_rating)))

    # -- booking history of one customer ---------------------------------------
    def booking_history_literal(self, customer_id: str, page_no: int = 1) -> DataFrame:
        """Quirk Q6: LIMIT/OFFSET count the rows of the chain join (booking x
        its rooms x its cancel rows, rooms then cancels in id order), so a
        booking can be cut across pages; each booking's scalars come from its
        first row on the page.

        The joined rows are never produced: each booking has max(rooms,1) *
        max(cancels,1) of them, every booking has at least one, so only the
        first ``page_no * 10`` bookings (a top-k) can reach the page; their
        row ranges follow from a prefix sum over those few rows, and a row's
        cancel is its index modulo the booking's cancel count."""
        fx = self.fx
        lo, hi = (page_no - 1) * PAGE_SIZE + 1, page_no * PAGE_SIZE
        mine = customer_bookings(fx, customer_id).drop("_rank")
        total = mine.select(F.count_distinct("booking_id")).scalar()
        hotels = semi_any(fx.hotels(), mine, "hotel_id").select("hotel_id", "hotel_name")
        top = mine.join(hotels, "hotel_id").orderBy(*newest_first()).limit(hi)      # <= hi bookings
        rooms = semi_any(fx.booking_rooms(), top, "booking_id")     # page_no pages of bookings
        cancels = semi_any(fx.bookings_cancelled(), top, "booking_id")
        nr = rooms.groupBy("booking_id").agg(F.count(F.lit(1)).alias("_nr"))
        nc = cancels.groupBy("booking_id").agg(F.count(F.lit(1)).alias("_nc"))
        t = (top.join(nr, "booking_id", "left").join(nc, "booking_id", "left")
             .withColumn("_c", F.coalesce("_nc", F.lit(1)))
             .withColumn("_rows", F.coalesce("_nr", F.lit(1)) * F.col("_c")))
        before = Window.orderBy(*newest_first()).rowsBetween(Window.unboundedPreceding, -1)   # <= hi rows
        t = t.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)) + 1)
        first = F.greatest(F.col("_start"), F.lit(lo))
        last = F.least(F.col("_start") + F.col("_rows") - 1, F.lit(hi))
        t = (t.where(first <= last)
             .withColumn("page_pos", (first - lo + 1).cast("long"))
             .withColumn("n_room_entries", (last - first + 1).cast("long"))
             .withColumn("_b", ((first - F.col("_start")) % F.col("_c")).cast("long") + 1))
        ranked = rank_within_groups(cancels.select("booking_id", "booking_cancel_id", "cancel_reason"),
                                    ["booking_id"], [F.col("booking_cancel_id")], pos_col="_b")
        cust = children(fx, "customers", t, "customer_id").select(
            "customer_id", F.col("full_name").alias("customer_name"))
        out = (t.join(ranked.select("booking_id", "_b", "cancel_reason"), ["booking_id", "_b"], "left")
               .join(cust, "customer_id", "left"))
        return out.select(
            F.col("hotel_name").alias("hotelName"), "booking_id", "hotel_id", "cancel_reason",
            as_double("total_amount").alias("total_amount"), "booking_status", "customer_name",
            "n_room_entries", "page_pos", total.alias("total_bookings"), page_count(total).alias("total_pages"),
            F.lit(page_no).cast("int").alias("current_page")).transform(in_page_order)

    def _listed(self, mine: DataFrame) -> DataFrame:
        """A customer's bookings of existing hotels, with the hotel's name (Q7)."""
        hotels = semi_any(self.fx.hotels(), mine, "hotel_id").select("hotel_id", "hotel_name")
        return mine.join(hotels, "hotel_id")

    # -- the pages alone, for their children (plans.children) -------------------
    def history_bookings(self, customer_id: str, page_no: int = 1) -> DataFrame:
        """page_pos, booking_id of a page of the history."""
        return history_page(self._listed(customer_bookings(self.fx, customer_id)), page_no).select("page_pos", "booking_id")

    def directory_page(self, page_no: int = 1) -> DataFrame:
        """page_pos, hotel_id of a page of the directory."""
        return newest_hotels(self.fx, page_no).select("page_pos", "hotel_id")

    def city_country_page(self, city: str = "", country: str = "", page_no: int = 1) -> DataFrame:
        """page_pos, hotel_id of a page of the city/country search."""
        hotels = self.fx.hotels().select(*HOTEL_COLS).where(like_ci("city", (city or "").lower()) & like_ci("country", (country or "").lower()))
        return page(hotels, [F.col("hotel_id").asc(), F.col("id").asc()], page_no).select("page_pos", "hotel_id")

    def booking_history(self, customer_id: str, page_no: int = 1, envelope: bool = False) -> DataFrame:
        fx = self.fx
        mine = customer_bookings(fx, customer_id)
        total = mine.select(F.count_distinct("booking_id")).scalar()
        listed = self._listed(mine)
        total_listed = listed.select(F.count(F.lit(1))).scalar()
        if envelope:
            return self._envelope({"total_bookings": total, "total_listed": total_listed,
                                   "total_pages": page_count(total)}, page_no)
        pg = history_page(listed, page_no)
        cust = children(fx, "customers", pg, "customer_id").select(
            "customer_id", F.col("full_name").alias("customer_name"))
        br = (children(fx, "booking_rooms", pg, "booking_id")
              .groupBy("booking_id")
              .agg(F.count(F.lit(1)).alias("n_rooms"), F.sum("room_amount").alias("rooms_amount")))
        bc = agg.latest_cancel(children(fx, "bookings_cancelled", pg, "booking_id"))
        out = (pg.join(cust, "customer_id", "left").join(br, "booking_id", "left")
               .join(bc, "booking_id", "left"))
        return out.select(
            F.col("hotel_name").alias("hotelName"), "booking_id", "hotel_id", "cancel_reason",
            as_double("total_amount").alias("total_amount"), "booking_status", "customer_name",
            F.coalesce("n_rooms", F.lit(0)).cast("long").alias("n_rooms"),
            as_double("rooms_amount").alias("rooms_amount"), "page_pos",
            total.alias("total_bookings"), total_listed.alias("total_listed"),
            page_count(total).alias("total_pages"), F.lit(page_no).cast("int").alias("current_page"),
        ).transform(in_page_order)
