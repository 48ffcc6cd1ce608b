"""Domain tables of the lodging model, derived from the driver's base tables.

The reference ships no data, so each table (hotels, rooms, bookings, ...) and
each command table (hotel_requests, booking_request_rooms, ...) is a view over
the TPC-H-ish parquet files, exactly as specified in FIXTURES.md.  The same
definitions exist as SQL text for the DuckDB oracle (``innkeep.oracle.views``).

Plan notes (scale):
* ``n`` (the hotel count) is a scalar subquery, evaluated once and inlined;
  no cross join with a one-row table.
* nation/region are fixed-size TPC-H dimensions (25 and 5 rows): broadcast.
* The row-multiplying ``CROSS JOIN (0),(1)`` of the SQL is an ``explode`` of a
  literal array here: a generator, not a join.
* The only window is ``ROW_NUMBER() OVER (PARTITION BY l_orderkey ..)`` whose
  groups are the lines of one order (at most 7).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from innkeep.functions.ids import pad5
from innkeep.sources.tables import Tables

DOMAIN_TABLES = ("hotels", "rooms", "customers", "bookings", "booking_rooms",
                 "bookings_cancelled", "reviews", "services", "employees",
                 "maintenance")
COMMAND_TABLES = ("hotel_requests", "hotel_request_rooms", "hotel_request_services",
                  "booking_requests", "booking_request_rooms", "cancel_requests",
                  "review_requests", "maintenance_requests", "maintenance_updates")


def _room_type(p_type: Column) -> Column:
    return (F.when(p_type.isin("PROMO", "LARGE"), "Suite")
            .when(p_type.isin("MEDIUM", "ECONOMY"), "Deluxe")
            .otherwise("Standard"))


def _floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def _date_plus_days(ts: Column, days: Column) -> Column:
    return F.date_add(F.to_date(ts), days.cast("int"))


class Fixtures:
    """All domain and command tables for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.t = Tables(spark, sf_dir)

    # -- shared pieces -------------------------------------------------------
    @property
    def n(self) -> Column:
        """Number of hotels: every key is spread over hotels by ``% n``."""
        return self.t.supplier.select(F.count(F.lit(1))).scalar()

    def _geo(self) -> DataFrame:
        nation = self.t.nation.select("n_nationkey", "n_name", "n_regionkey")
        region = self.t.region.select("r_regionkey", "r_name")
        return F.broadcast(nation.join(F.broadcast(region),
                                       nation.n_regionkey == region.r_regionkey))

    def _with_geo(self, df: DataFrame, key: str) -> DataFrame:
        geo = self._geo()
        return df.join(geo, df[key] == geo.n_nationkey)

    # -- domain tables ---------------------------------------------------------
    def hotels(self) -> DataFrame:
        s = self._with_geo(self.t.supplier, "s_nationkey")
        k = F.col("s_suppkey")
        first_order = self.t.orders.select(F.min("o_orderdate")).scalar()
        hours = ((k * 7919) % 1009).cast("int")
        return s.select(
            k.alias("id"),
            pad5("HOT", k + 1).alias("hotel_id"),
            F.col("s_name").alias("hotel_name"),
            F.when(k % 40 != 39, F.col("n_name")).alias("city"),
            F.col("r_name").alias("country"),
            F.lit(None).cast("int").alias("star_rating"),
            F.when(k % 20 == 7, 2).otherwise(20 + k % 5).cast("int").alias("total_rooms"),
            (first_order + F.make_dt_interval(hours=hours)).cast("timestamp_ntz").alias("created_at"),
        )

    def rooms(self) -> DataFrame:
        """Every part is a room; those that would fall to each 25th hotel are
        an annex (``B`` numbers) of the hotel before, so some have none."""
        n = self.n
        k = F.col("p_partkey")
        h = k % n
        annex = h % 25 == 24
        return (self.t.part
                .select(
                    k.alias("id"),
                    pad5("ROOM", k + 1).alias("room_id"),
                    pad5("HOT", h - annex.cast("int") + 1).alias("hotel_id"),
                    F.concat((100 + _floor_div(k, n)).cast("string"), F.when(annex, "B").otherwise("")).alias("room_number"),
                    _room_type(F.col("p_type")).alias("room_type"),
                    F.when(F.col("p_size") != 50,
                           F.col("p_retailprice").cast("decimal(10,2)")).alias("price_per_night"),
                    (F.col("p_size") % 3 != 0).alias("is_available"),
                ))

    def customers(self) -> DataFrame:
        """Some e-mail addresses are absent, malformed or those of the customer
        before; some phone numbers are absent or too long."""
        c = self._with_geo(self.t.customer, "c_nationkey")
        k = F.col("c_custkey")
        return c.select(
            F.col("c_custkey").alias("id"),
            pad5("CUST", F.col("c_custkey") + 1).alias("customer_id"),
            F.col("c_name").alias("full_name"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("country"),
            F.when(k % 31 == 30, F.lit(None).cast("string"))
             .when(k % 29 == 28, F.concat(F.lit("guest "), k.cast("string"), F.lit(" at example.com")))
             .otherwise(F.concat(F.lit("guest"), (k - (k % 37 == 36).cast("int")).cast("string"), F.lit("@example.com"))).alias("email"),
            F.when(k % 41 == 40, F.lit(None).cast("string"))
             .when(k % 43 == 42, F.concat(F.lit("+49 30 1234 5678 9012 "), k.cast("string")))
             .otherwise(F.concat(F.lit("+49 30 "), (100000 + k).cast("string"))).alias("phone"),
        )

    def _bookings_base(self) -> DataFrame:
        n = self.n
        k = F.col("o_orderkey")
        return self.t.orders.select(
            k.alias("id"),
            pad5("BOOK", k + 1).alias("booking_id"),
            F.when(k % 97 == 96, "CUST00000")
             .otherwise(pad5("CUST", F.col("o_custkey") + 1)).alias("customer_id"),
            F.when(k % 50 == 49, "HOT00000")
             .otherwise(pad5("HOT", k % n + 1)).alias("hotel_id"),
            F.col("o_totalprice").cast("decimal(10,2)").alias("total_amount"),
            F.when(k % 101 == 0, F.lit(None).cast("string"))
             .when(F.col("o_orderstatus") == "F", "Cancelled")
             .when(F.col("o_orderstatus") == "O", "Confirmed")
             .otherwise("Completed").alias("booking_status"),
            F.col("o_orderdate").alias("created_at"),
            F.col("o_orderstatus"),
            F.col("o_orderpriority"),
        )

    def bookings(self) -> DataFrame:
        return self._bookings_base().drop("o_orderstatus", "o_orderpriority")

    def booking_rooms(self) -> DataFrame:
        n = self.n
        li = self.t.lineitem
        w = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        return (li.withColumn("rn", F.row_number().over(w))
                .select(
                    F.concat(F.lit("BR"), F.col("l_orderkey").cast("string"), F.lit("-"),
                             F.col("rn").cast("string")).alias("booking_room_id"),
                    pad5("BOOK", F.col("l_orderkey") + 1).alias("booking_id"),
                    (100 + _floor_div(F.col("l_partkey"), n)).cast("string").alias("room_number"),
                    F.to_date("l_shipdate").alias("check_in"),
                    _date_plus_days(F.col("l_shipdate"), F.col("l_quantity")).alias("check_out"),
                    F.col("l_extendedprice").cast("decimal(10,2)").alias("room_amount"),
                ))

    def bookings_cancelled(self) -> DataFrame:
        b = self._bookings_base().where(F.col("o_orderstatus") == "F")
        ks = F.when(F.col("id") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return (b.withColumn("k", F.explode(ks))
                .select(
                    F.concat(F.lit("BOOKCANCEL"), (F.col("id") * 2 + F.col("k")).cast("string"))
                     .alias("booking_cancel_id"),
                    "booking_id", "customer_id", "hotel_id", "total_amount",
                    F.when(F.col("k") == 0, F.col("o_orderpriority"))
                     .otherwise(F.lit("second request")).alias("cancel_reason"),
                ))

    def reviews(self) -> DataFrame:
        """Every event is a review; each 10th hotel's go to the one before, so
        some have none."""
        n = self.n
        e = F.col("event_id")
        h = e % n
        return (self.t.events
                .select(
                    e.alias("id"),
                    pad5("REV", e + 1).alias("review_id"),
                    pad5("HOT", h - (h % 10 == 9).cast("int") + 1).alias("hotel_id"),
                    F.when(e % 17 == 0, "CUST00000")
                     .otherwise(pad5("CUST", F.col("user_id") + 1)).alias("customer_id"),
                    (1 + F.floor("value").cast("int") % 5).cast("int").alias("rating"),
                    F.when(F.col("event_type") != "error", F.col("event_type")).alias("comment"),
                    F.to_date("ts").alias("review_date"),
                ))

    def services(self) -> DataFrame:
        n = self.n
        k = F.col("p_partkey")
        type_no = (F.when(F.col("p_type") == "ECONOMY", 1).when(F.col("p_type") == "LARGE", 2)
                   .when(F.col("p_type") == "MEDIUM", 3).when(F.col("p_type") == "PROMO", 4)
                   .when(F.col("p_type") == "SMALL", 5).otherwise(6))
        g = (self.t.part
             .groupBy((k % n).alias("h"), F.col("p_type"))
             .agg(F.min("p_size").alias("min_size")))
        return g.select(
            pad5("SERV", F.col("h") * 6 + type_no).alias("service_id"),
            pad5("HOT", F.col("h") + 1).alias("hotel_id"),
            F.col("p_type").alias("service_name"),
            F.col("min_size").cast("decimal(10,2)").alias("service_charge"),
        )

    def employees(self) -> DataFrame:
        n = self.n
        k = F.col("c_custkey")
        return self.t.customer.select(
            pad5("EMP", k + 1).alias("employee_id"),
            pad5("HOT", k % n + 1).alias("hotel_id"),
            F.col("c_name").alias("full_name"),
            F.when(F.col("c_mktsegment") == "BUILDING", "employee")
             .otherwise(F.lower("c_mktsegment")).alias("role"),
            F.col("c_acctbal").cast("decimal(10,2)").alias("salary"),
            F.date_add(F.lit("2015-01-01").cast("date"), (k % 3000).cast("int")).alias("hire_date"),
        )

    def maintenance(self) -> DataFrame:
        n = self.n
        e = F.col("event_id")
        return (self.t.events
                .where(F.col("event_type") == "error")
                .select(
                    pad5("MAINTAIN", e + 1).alias("maintenance_id"),
                    pad5("HOT", e % n + 1).alias("hotel_id"),
                    (100 + F.col("user_id") % 20).cast("string").alias("room_number"),
                    pad5("EMP", F.col("user_id") + 1).alias("employee_id"),
                    F.col("props").alias("issue_description"),
                    F.to_date("ts").alias("maintenance_date"),
                    F.when(e % 3 == 0, "Pending").when(e % 3 == 1, "Completed")
                     .otherwise("Cancelled").alias("maintenance_status"),
                ))

    # -- command tables (one row per request, items flat with request_seq/pos) --
    def hotel_requests(self) -> DataFrame:
        s = self._with_geo(self.t.supplier, "s_nationkey")
        k = F.col("s_suppkey")
        return s.select(
            k.alias("request_seq"),
            F.when(k % 10 == 4, pad5("HOT", k - 1))
             .when(k % 2 == 0, pad5("HOT", k + 1)).alias("hotel_id"),
            F.when(k % 11 == 10, F.lit("")).otherwise(F.concat("s_name", F.lit(" v2"))).alias("hotel_name"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("country"),
            F.when(k % 13 == 12, F.lit("12.345")).otherwise((15 + k % 10).cast("string")).alias("total_rooms"),
        )

    def hotel_request_rooms(self) -> DataFrame:
        n = self.n
        k = F.col("p_partkey")
        return (self.t.part
                .select(
                    (k % n).alias("request_seq"),
                    k.alias("pos"),
                    (110 + _floor_div(k, n) % F.when((k % n) % 3 == 0, 19).otherwise(23)).cast("string").alias("room_number"),
                    _room_type(F.col("p_type")).alias("room_type"),
                    F.col("p_retailprice").cast("string").alias("price_per_night"),
                    F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 2 == 0).alias("is_available"),
                ))

    def hotel_request_services(self) -> DataFrame:
        n = self.n
        k = F.col("p_partkey")
        size = F.col("p_size")
        line = F.when((k % n) % 5 == 2, F.lit("")).otherwise(F.concat(F.lit("-"), _floor_div(k, n).cast("string")))
        return (self.t.part
                .select(
                    (k % n).alias("request_seq"),
                    k.alias("pos"),
                    F.when(size % 10 == 0, pad5("SERV", (k % n) * 6 + 1)).alias("service_id"),
                    F.when(size % 9 == 0, F.lit("")).when(size % 2 == 0, F.concat("p_brand", line))
                     .otherwise(F.lower(F.concat("p_brand", line))).alias("service_name"),
                    F.when((size % 23 != 0) | ((k % n) % 4 != 1), size.cast("string")).alias("service_charge"),
                ))

    def booking_requests(self) -> DataFrame:
        n = self.n
        k = F.col("o_orderkey")
        return (self.t.orders
                .select(
                    k.alias("request_seq"),
                    pad5("CUST", F.col("o_custkey") + 1).alias("customer_id"),
                    F.when(k % 90 == 0, "HOT00000")
                     .otherwise(pad5("HOT", _floor_div(k, F.lit(10)) % n + 1)).alias("hotel_id"),
                    F.when(k % 130 == 0, F.lit("abc"))
                     .otherwise(F.col("o_totalprice").cast("decimal(10,2)").cast("string")).alias("total_amount"),
                    F.when(k % 170 == 0, F.lit("Unknown")).otherwise(F.lit(None).cast("string"))
                     .alias("booking_status"),
                ))

    def booking_request_rooms(self) -> DataFrame:
        n = self.n
        li = self.t.lineitem
        w = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
        check_in = F.to_date("l_shipdate").cast("string")
        return (li.withColumn("pos", F.row_number().over(w).cast("long"))
                .select(
                    F.col("l_orderkey").alias("request_seq"),
                    "pos",
                    (100 + _floor_div(F.col("l_partkey"), n)
                     + F.when(F.col("l_tax") > 0.075, 500).otherwise(0)).cast("string").alias("room_number"),
                    check_in.alias("check_in"),
                    F.when(F.col("l_linenumber") == 7, check_in)
                     .otherwise(_date_plus_days(F.col("l_shipdate"), F.col("l_quantity")).cast("string"))
                     .alias("check_out"),
                    F.col("l_extendedprice").cast("decimal(10,2)").cast("string").alias("room_amount"),
                ))

    def cancel_requests(self) -> DataFrame:
        o = self.t.orders
        other = self.t.orders.select(F.col("o_orderkey").alias("k2"), F.col("o_custkey").alias("c2"))
        k = F.col("o_orderkey")
        j = o.join(other, k * 2 == other.k2, "left")
        return j.select(
            k.alias("request_seq"),
            pad5("BOOK", k * 2 + 1).alias("booking_id"),
            F.when(k % 5 == 0, F.lit("CUST00001"))
             .otherwise(pad5("CUST", F.col("c2") + 1)).alias("customer_id"),
            F.when(k % 49 == 0, F.lit("HOT00000")).otherwise(pad5("HOT", k * 2 % self.n + 1)).alias("hotel_id"),
            F.when(k % 4 == 0, F.lit("no"))
             .otherwise(F.concat("o_orderpriority", F.lit(" plans changed"))).alias("cancel_reason"),
            F.when(k % 23 == 22, F.concat(F.lit("BOOKCANCEL-"), pad5("", k * 1000003 + 1000000000)))
             .when(k % 3 == 0, pad5("BOOKCANCEL", k)).alias("booking_cancel_id"),
        )

    def review_requests(self) -> DataFrame:
        n = self.n
        e = F.col("event_id")
        m8 = e % 8
        return (self.t.events
                .where(F.col("event_type") == "purchase")
                .select(
                    e.alias("request_seq"),
                    F.when(e % 19 == 0, "HOT00000").otherwise(pad5("HOT", e % n + 1)).alias("hotel_id"),
                    F.when(e % 23 == 0, "CUST00000")
                     .otherwise(pad5("CUST", F.col("user_id") + 1)).alias("customer_id"),
                    F.when(m8 == 0, "6").when(m8 == 1, "4.5").when(m8 == 2, "0").when(m8 == 3, "3.125")
                     .when(m8 == 4, "").otherwise((e % 5 + 1).cast("string")).alias("rating"),
                    F.when(e % 3 == 0, F.lit(""))
                     .otherwise(F.concat(F.lit(" "), F.col("props"), F.lit(" "))).alias("comment"),
                ))

    def maintenance_requests(self) -> DataFrame:
        n = self.n
        e = F.col("event_id")
        seq = _floor_div(e, F.lit(3))
        return (self.t.events
                .where(F.col("event_type").isin("view", "click"))
                .select(
                    seq.alias("request_seq"),
                    e.alias("pos"),
                    pad5("HOT", seq % n + 1).alias("hotel_id"),
                    pad5("EMP", seq % (n * 15) + 1).alias("employee_id"),
                    (100 + e % 21).cast("string").alias("room_number"),
                    F.when(e % 31 == 0, F.lit("bad"))
                     .otherwise(F.concat(F.lit("issue "), F.col("props"))).alias("issue_description"),
                    F.when(e % 37 == 0, F.lit("not a date"))
                     .otherwise(F.to_date("ts").cast("string")).alias("maintenance_date"),
                    F.when(e % 5 == 0, F.lit(None).cast("string")).when(e % 41 == 0, "Unknown")
                     .otherwise("Completed").alias("maintenance_status"),
                    F.when(e % 43 == 42, F.concat(F.lit("MAINTENANCE-"), pad5("", e + 1000000000)))
                     .when(e % 2 == 0, pad5("MAINTAIN", e)).alias("maintenance_id"),
                ))

    def maintenance_updates(self) -> DataFrame:
        n = self.n
        e = F.col("event_id")
        ks = F.when(e % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        ev = (self.t.events.where(F.col("event_type").isin("error", "signup"))
              .withColumn("k", F.explode(ks)))
        k = F.col("k").cast("long")
        st = (e + k * (e % 2)) % 4
        return ev.select(
            (e * 2 + k).alias("request_seq"),
            pad5("MAINTAIN", e + 1).alias("maintenance_id"),
            pad5("HOT", e % n + 1).alias("hotel_id"),
            (100 + F.col("user_id") % 20 + F.when(e % 13 == 0, 1).otherwise(0)).cast("string")
             .alias("room_number"),
            pad5("EMP", (e + k) % (n * 15) + 1).alias("employee_id"),
            F.when(st == 0, "Pending").when(st == 1, "Completed").when(st == 2, "Cancelled")
             .otherwise("Unknown").alias("maintenance_status"),
        )

    def pages(self) -> DataFrame:
        return self.t.pages

    # -- access by name ----------------------------------------------------------
    def table(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def register_views(self, names=DOMAIN_TABLES + COMMAND_TABLES) -> None:
        for name in names:
            self.table(name).createOrReplaceTempView(name)
