"""Stored layout of the domain tables.

At scale the domain tables are stored, not derived per query.  Layouts:

* ``partitioned`` (default): each table is partitioned by a hash bucket of its
  key (``_bucket``), and inside a bucket ranged and sorted by (key, unique id).
  A page of keys, or one key, reads only the buckets these keys hash to: by
  dynamic partition pruning from the page, or as a plain partition filter.  A
  hot key's bucket is many files, read by many tasks.
* ``clustered``: range-partitioned and sorted by (key, unique id) without the
  bucket column; literal key filters skip row groups, pages prune nothing.
* ``bucketed``: ``bucketBy(n, key)``: scans report ``HashPartitioning(key)``, so
  per-key aggregations and joins run without a shuffle.  Every row of one key
  is in one bucket, read by one task, so use it only for evenly spread keys.

The partitioned layout adds two tables for reads by another key or order:

* ``hotels_newest``: the hotels with their rank in newest-first order,
  partitioned by range of rank.  The partition of a page follows from its
  number, so page 10,000 reads one partition, as page 1 does.
* ``bookings_by_customer``: the bookings by customer, with their rank in the
  customer's history (newest first, bookings of a missing hotel unranked).

Tables are written with ``saveAsTable`` into the session catalog's warehouse
(the cluster's shared warehouse location).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.operators.ranking import PAGE_SIZE, global_rank, rank_within_groups

# Storage key and unique id of each domain table.
LAYOUT = {
    "hotels": (("hotel_id",), "id"),
    "rooms": (("hotel_id",), "room_id"),
    "services": (("hotel_id",), "service_id"),
    "reviews": (("hotel_id",), "review_id"),
    "bookings": (("hotel_id",), "booking_id"),
    "employees": (("hotel_id",), "employee_id"),
    "maintenance": (("hotel_id",), "maintenance_id"),
    "booking_rooms": (("booking_id",), "booking_room_id"),
    "bookings_cancelled": (("booking_id",), "booking_cancel_id"),
    "customers": (("customer_id",), "customer_id"),
}
BUCKET = "_bucket"
RANGE_ROWS = 100_000          # ranks of one partition of a ranked table; a multiple of the page size
_BUCKETS = "innkeep.buckets"  # table property: the number of hash buckets


def bucket_of(key: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def by_bucket(df: DataFrame, key: str, uid: str, n: int) -> DataFrame:
    """``df`` with its bucket column, ready to be written partitioned by it:
    files follow ranges of (bucket, key, unique id)."""
    order = list(dict.fromkeys([BUCKET, key, uid]))
    return df.withColumn(BUCKET, bucket_of(key, n)).repartitionByRange(*order).sortWithinPartitions(*order)


def ranked_in_ranges(df: DataFrame, order: Sequence[str | Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``_rank`` (from 1, along ``order``) and ``_range``, the range
    of ranks it is stored under."""
    if range_rows % PAGE_SIZE:
        raise ValueError("a range holds whole pages")
    ranked = global_rank(df, order, rank_col="_rank").withColumn("_range", F.floor((F.col("_rank") - 1) / range_rows).cast("long"))
    return ranked.sortWithinPartitions("_range", "_rank")


def ranked_page(stored: DataFrame, page_no: int, size: int = PAGE_SIZE, range_rows: int = RANGE_ROWS, pos_col: str | None = "page_pos") -> DataFrame:
    """Page ``page_no`` of a table written as :func:`ranked_in_ranges`: one
    partition, chosen by the page's number, and in it the row groups that hold
    its ranks."""
    if page_no < 1:
        raise ValueError("page must be >= 1")
    if range_rows % size:
        raise ValueError("a range holds whole pages")
    first = (page_no - 1) * size + 1
    out = stored.where((F.col("_range") == (first - 1) // range_rows) & F.col("_rank").between(first, first + size - 1))
    if pos_col:
        out = out.withColumn(pos_col, F.col("_rank") - (first - 1))
    return out.drop("_rank", "_range")


def newest_first() -> list[Column]:
    """ORDER BY created_at DESC, with the surrogate id as tie-break."""
    return [F.col("created_at").desc(), F.col("id").asc()]


def publish_tables(tables, database: str, buckets: int | None = None, layout: str = "partitioned",
                   names: tuple[str, ...] = tuple(LAYOUT), range_rows: int = RANGE_ROWS) -> None:
    """Write each domain table of ``tables`` (a Fixtures/FrameSet) as the
    Parquet table ``database.name`` in the chosen layout.  ``buckets`` is the
    number of hash buckets, or of files in the other layouts."""
    spark: SparkSession = tables.spark
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")

    def save(writer, name: str) -> None:
        writer.mode("overwrite").format("parquet").saveAsTable(f"{database}.{name}")

    for name in names:
        keys, uid = LAYOUT[name]
        order = list(dict.fromkeys([*keys, uid]))
        df = tables.table(name)
        if layout == "bucketed":
            # one file per bucket: each task holds exactly one bucket
            save(df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys), name)
        elif layout == "clustered":
            save(df.repartitionByRange(n, *order).sortWithinPartitions(*order).write, name)
        elif layout == "partitioned":
            save(by_bucket(df, keys[0], uid, n).write.partitionBy(BUCKET), name)
            spark.sql(f"ALTER TABLE {database}.{name} SET TBLPROPERTIES ('{_BUCKETS}' = '{n}')")
        else:
            raise ValueError(layout)
    if layout == "partitioned" and "hotels" in names:
        stored = CatalogTables(spark, database)
        save(ranked_in_ranges(stored.hotels(), newest_first(), range_rows).write.partitionBy("_range")
             .option("innkeep.range_rows", range_rows), "hotels_newest")
        spark.sql(f"ALTER TABLE {database}.hotels_newest SET TBLPROPERTIES ('innkeep.range_rows' = '{range_rows}')")
        if "bookings" in names:
            bookings, known = stored.bookings(), stored.hotels().select("hotel_id")
            listed = rank_within_groups(bookings.join(known, "hotel_id", "left_semi"), ["customer_id"], newest_first(), pos_col="_rank")
            other = bookings.join(known, "hotel_id", "left_anti").withColumn("_rank", F.lit(None).cast("long"))
            both = listed.select(*other.columns).unionByName(other)
            save(by_bucket(both, "customer_id", "_rank", n).write.partitionBy(BUCKET), "bookings_by_customer")
            spark.sql(f"ALTER TABLE {database}.bookings_by_customer SET TBLPROPERTIES ('{_BUCKETS}' = '{n}')")


class CatalogTables:
    """Table provider over published tables; other names (the command
    tables) come from ``base``."""

    def __init__(self, spark: SparkSession, database: str, base=None):
        self.spark = spark
        self.database = database
        self.base = base

    def table(self, name: str) -> DataFrame:
        if name in LAYOUT:
            return self.spark.table(f"{self.database}.{name}").drop(BUCKET)
        if self.base is None:
            raise KeyError(name)
        return self.base.table(name)

    def _property(self, name: str, key: str) -> int | None:
        """A table property that says how the table is laid out."""
        if not self.spark.catalog.tableExists(f"{self.database}.{name}"):
            return None
        found = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.database}.{name}").collect()}
        return int(found[key]) if key in found else None

    def children_of(self, name: str, keys: DataFrame, on: str) -> DataFrame | None:
        """The rows of ``name`` whose key is in ``keys`` (a page: a few rows),
        from the buckets of these keys only; None without such buckets.

        The comparison with the empty string keeps every key; it is what makes
        Spark see the keys as a selective side, so that it prunes."""
        n = self._property(name, _BUCKETS) if LAYOUT[name][0] == (on,) else None
        if n is None:
            return None
        wanted = keys.select(on).distinct().where(F.col(on) >= "").withColumn(BUCKET, bucket_of(on, n))
        return self.spark.table(f"{self.database}.{name}").join(F.broadcast(wanted), [BUCKET, on], "left_semi").drop(BUCKET)

    def hotels_page(self, page_no: int) -> DataFrame | None:
        rows = self._property("hotels_newest", "innkeep.range_rows")
        return None if rows is None else ranked_page(self.spark.table(f"{self.database}.hotels_newest"), page_no, range_rows=rows)

    def bookings_of(self, customer_id: str) -> DataFrame | None:
        """A customer's bookings with ``_rank``, from one bucket."""
        n = self._property("bookings_by_customer", _BUCKETS)
        if n is None:
            return None
        stored = self.spark.table(f"{self.database}.bookings_by_customer")
        return stored.where((F.col(BUCKET) == bucket_of(F.lit(customer_id), n)) & (F.col("customer_id") == F.lit(customer_id))).drop(BUCKET)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return lambda: self.table(name)
