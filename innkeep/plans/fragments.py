"""Nested answer documents in pieces of bounded size.

A page's document has every child of its hotels, and a hotel may have a
million bookings.  So a document is written as numbered fragments: its entries
(the hotel itself, rooms, services, reviews, bookings and their rooms and
cancel reasons) in one order, cut where their JSON text has added up to
``FRAGMENT_BYTES``.  The cut comes from prefix sums over all entries, so no
hotel is collected in one place; a fragment, which is, has one entry more than
its size at most.  Fragments are written as JSON lines, one a row, and read in
the order (hotel_id, fragment); their entries say which array they belong to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.operators.ranking import prefix_sums
from innkeep.plans.children import PageChildren
from innkeep.plans.directory import HotelAnswers, newest_hotels, ts_text

FRAGMENT_BYTES = 1 << 16

#: sections of a document, in order (fixed values), and the fields of their entries
SECTIONS = {
    "hotel": ("hotel_id", "hotel_name", "city", "country", "total_rooms", "created_at"),
    "rooms": ("room_number", "room_type", "price_per_night", "is_available"),
    "services": ("service_id", "service_name", "service_charge"),
    "reviews": ("customer_name", "rating", "comment", "review_date"),
    "bookings": ("booking_id", "customer_name", "status", "total_amount"),
    "booking_rooms": ("booking_id", "room_number", "check_in", "check_out", "room_amount"),
    "booking_cancels": ("booking_id", "cancel_reason"),
}


def document_entries(fx, page_no: int = 1) -> DataFrame:
    """page_pos, hotel_id, section (number), pos, sub_pos, entry (JSON) of the
    directory page's documents."""
    hotels = newest_hotels(fx, page_no).withColumn("created_at", ts_text("created_at")).withColumn("pos", F.lit(1).cast("long"))
    parts = PageChildren(fx, HotelAnswers(fx).directory_page(page_no))
    out = None
    for number, (section, fields) in enumerate(SECTIONS.items()):
        rows = hotels if section == "hotel" else getattr(parts, section)()
        if "booking_pos" in rows.columns:
            rows = rows.withColumn("sub_pos", F.col("pos")).withColumn("pos", F.col("booking_pos"))
        else:
            rows = rows.withColumn("sub_pos", F.lit(0).cast("long"))
        rows = rows.select("page_pos", "hotel_id", F.lit(number).alias("section"), "pos", "sub_pos", F.to_json(F.struct(*fields)).alias("entry"))
        out = rows if out is None else out.unionByName(rows)
    return out


def fragment_entries(entries: DataFrame, fragment_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """``entries`` with the number (from 0) of the fragment each is in."""
    sized = entries.withColumn("bytes", F.octet_length("entry").cast("long"))
    summed = prefix_sums(sized, ["hotel_id"], ["section", "pos", "sub_pos"], "bytes")
    return summed.withColumn("fragment", F.floor(F.col("before") / fragment_bytes).cast("long")).drop("before")


def fragments(entries: DataFrame) -> DataFrame:
    """One row a fragment: page_pos, hotel_id, fragment and its JSON text, an
    object with an array for every section it has entries of."""
    arrays = entries.groupBy("page_pos", "hotel_id", "fragment").agg(
        F.array_sort(F.collect_list(F.struct("section", "pos", "sub_pos", "entry"))).alias("e"))   # bounded bytes
    names = list(SECTIONS)

    def section(number: int):
        own = F.transform(F.filter("e", lambda x: x["section"] == number), lambda x: x["entry"])
        return F.when(F.size(own) > 0, F.concat(F.lit(f'"{names[number]}":['), F.array_join(own, ","), F.lit("]")))

    body = F.concat_ws(",", F.concat(F.lit('"hotel_id":'), F.to_json(F.array("hotel_id")).substr(F.lit(2), F.length(F.to_json(F.array("hotel_id"))) - 2)),
                       F.concat(F.lit('"fragment":'), F.col("fragment").cast("string")), *(section(i) for i in range(len(names))))
    return arrays.select("page_pos", "hotel_id", "fragment", F.concat(F.lit("{"), body, F.lit("}")).alias("document"))


def write_fragments(fx, path: str, page_no: int = 1, fragment_bytes: int = FRAGMENT_BYTES) -> None:
    """The directory page's documents as JSON lines under ``path``, in reading
    order within each file."""
    out = fragments(fragment_entries(document_entries(fx, page_no), fragment_bytes))
    (out.repartitionByRange("page_pos", "fragment").sortWithinPartitions("page_pos", "fragment")
     .select("document").write.text(path))
