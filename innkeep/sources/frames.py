"""Tables from explicit DataFrames (hand-written inputs, other storage).

Same interface as :class:`innkeep.sources.fixtures.Fixtures`: a method per
table name, ``table(name)`` and ``register_views``.  Every answer and job in
the library takes either."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# DDL of every table as the plans read it.
SCHEMAS = {
    "hotels": "id bigint, hotel_id string, hotel_name string, city string, country string, star_rating int, "
              "total_rooms int, created_at timestamp_ntz",
    "rooms": "id bigint, room_id string, hotel_id string, room_number string, room_type string, "
             "price_per_night decimal(10,2), is_available boolean",
    "customers": "id bigint, customer_id string, full_name string, city string, country string, "
                 "email string, phone string",
    "bookings": "id bigint, booking_id string, customer_id string, hotel_id string, total_amount decimal(10,2), "
                "booking_status string, created_at timestamp_ntz",
    "booking_rooms": "booking_room_id string, booking_id string, room_number string, check_in date, "
                     "check_out date, room_amount decimal(10,2)",
    "bookings_cancelled": "booking_cancel_id string, booking_id string, customer_id string, hotel_id string, "
                          "total_amount decimal(10,2), cancel_reason string",
    "reviews": "id bigint, review_id string, hotel_id string, customer_id string, rating int, comment string, "
               "review_date date",
    "services": "service_id string, hotel_id string, service_name string, service_charge decimal(10,2)",
    "employees": "employee_id string, hotel_id string, full_name string, role string, "
                 "salary decimal(10,2), hire_date date",
    "maintenance": "maintenance_id string, hotel_id string, room_number string, employee_id string, "
                   "issue_description string, maintenance_date date, maintenance_status string",
    "hotel_requests": "request_seq bigint, hotel_id string, hotel_name string, city string, country string, "
                      "total_rooms string",
    "hotel_request_rooms": "request_seq bigint, pos bigint, room_number string, room_type string, "
                           "price_per_night string, is_available boolean",
    "hotel_request_services": "request_seq bigint, pos bigint, service_id string, service_name string, "
                              "service_charge string",
    "booking_requests": "request_seq bigint, customer_id string, hotel_id string, total_amount string, "
                        "booking_status string",
    "booking_request_rooms": "request_seq bigint, pos bigint, room_number string, check_in string, "
                             "check_out string, room_amount string",
    "cancel_requests": "request_seq bigint, booking_id string, customer_id string, hotel_id string, "
                       "cancel_reason string, booking_cancel_id string",
    "review_requests": "request_seq bigint, hotel_id string, customer_id string, rating string, comment string",
    "maintenance_requests": "request_seq bigint, pos bigint, hotel_id string, employee_id string, "
                            "room_number string, issue_description string, maintenance_date string, "
                            "maintenance_status string, maintenance_id string",
    "maintenance_updates": "request_seq bigint, maintenance_id string, hotel_id string, room_number string, "
                           "employee_id string, maintenance_status string",
    "pages": "page_id bigint, url string, html string",
}


def _filled(row, name: str):
    """A row given without the table's last columns has nulls there."""
    if not isinstance(row, tuple):
        return row
    return row + (None,) * (len(T.StructType.fromDDL(SCHEMAS[name]).fields) - len(row))


class FrameSet:
    """Explicit tables; names not given fall back to ``base`` (another table
    provider) or to an empty table of the right schema."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame | list] | None = None, base=None):
        self.spark = spark
        self.base = base
        self.frames: dict[str, DataFrame] = {}
        for name, value in (frames or {}).items():
            self.set(name, value)

    def set(self, name: str, value: DataFrame | list) -> "FrameSet":
        if not isinstance(value, DataFrame):
            value = self.spark.createDataFrame([_filled(row, name) for row in value], SCHEMAS[name])
        self.frames[name] = value
        return self

    def table(self, name: str) -> DataFrame:
        if name not in self.frames:
            if self.base is not None:
                return self.base.table(name)
            self.frames[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self.frames[name]

    def __getattr__(self, name: str):
        if name in SCHEMAS:
            return lambda: self.table(name)
        raise AttributeError(name)

    def register_views(self, names=None) -> None:
        for name in names or SCHEMAS:
            self.table(name).createOrReplaceTempView(name)
