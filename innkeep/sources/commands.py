"""Command (request) documents.

In the reference every write is a JSON request body: a header plus arrays of
item objects.  Here a batch of requests is a table with one row per request
and ``ARRAY<STRUCT>`` item columns, read either

* from JSON lines with an explicit schema (``read_command_json``; malformed
  lines land in ``_corrupt_record`` and become rejects), or
* from the flat fixture views (header + items keyed by request_seq/pos).

Items are nested per request with ``collect_list`` + ``array_sort`` by
position.  One request's items are bounded by the request body limit of the
web server (100 kB by default), so no group here grows with the data.

Every string field goes through ``sanitize_text`` first (strip unsafe HTML,
trim), exactly where the reference sanitizes: object fields, not strings that
sit directly in arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innkeep.functions.sanitize import sanitize_text

BOOKING_ROOM = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("room_number", T.StringType()),
    T.StructField("check_in", T.StringType()),
    T.StructField("check_out", T.StringType()),
    T.StructField("room_amount", T.StringType()),
])
BOOKING_COMMAND = T.StructType([
    T.StructField("request_seq", T.LongType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("hotel_id", T.StringType()),
    T.StructField("total_amount", T.StringType()),
    T.StructField("booking_status", T.StringType()),
    T.StructField("booking_rooms", T.ArrayType(BOOKING_ROOM)),
])


def nest(header: DataFrame, items: DataFrame, name: str, key: str = "request_seq",
         order: str = "pos") -> DataFrame:
    """header LEFT JOIN (items grouped into an array ordered by ``order``);
    a header without items gets an empty array."""
    fields = [c for c in items.columns if c != key]
    if fields[0] != order:
        fields.remove(order)
        fields.insert(0, order)
    arr = (items.groupBy(key)
           .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name)))
    empty = F.array().cast(arr.schema[name].dataType)
    return (header.join(arr, key, "left")
            .withColumn(name, F.coalesce(F.col(name), empty)))


def _holds_fields(kind: T.DataType) -> bool:
    """Whether values of this type hold object fields that are sanitized."""
    if isinstance(kind, T.ArrayType):
        return _holds_fields(kind.elementType)
    if isinstance(kind, T.MapType):
        return isinstance(kind.valueType, T.StringType) or _holds_fields(kind.valueType)
    return isinstance(kind, T.StructType) and any(isinstance(f.dataType, T.StringType) or _holds_fields(f.dataType) for f in kind.fields)


def _cleaned(value: Column, kind: T.DataType, in_array: bool = False) -> Column:
    """A value with every string field of every object in it sanitized, at any
    depth; strings that sit directly in arrays, and all else, stay."""
    if isinstance(kind, T.StringType):
        return value if in_array else sanitize_text(value)
    if not _holds_fields(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _cleaned(x, kind.elementType, in_array=True))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _cleaned(x, kind.valueType))
    fields = F.struct(*[_cleaned(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.when(value.isNotNull(), fields)


def sanitized(df: DataFrame, skip: tuple[str, ...] = ("request_seq", "pos")) -> DataFrame:
    """Sanitize the string fields of each row, and of the objects nested in it."""
    return df.select(*[F.col(f.name) if f.name in skip else _cleaned(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def booking_commands(fx, clean: bool = True, spread: bool = False) -> DataFrame:
    """``spread``: the shuffle's partitions stay apart (a named number of them
    is not merged by size), for work that is long for the bytes it reads."""
    header, items = fx.booking_requests(), fx.booking_request_rooms()
    if clean:
        header, items = sanitized(header), sanitized(items)
    if spread:
        header = header.repartition(int(header.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request_seq")
    return nest(header, items, "booking_rooms")


def hotel_commands(fx, clean: bool = True) -> DataFrame:
    header, rooms, services = fx.hotel_requests(), fx.hotel_request_rooms(), fx.hotel_request_services()
    if clean:
        header, rooms, services = sanitized(header), sanitized(rooms), sanitized(services)
    return nest(nest(header, rooms, "rooms"), services, "services")


def maintenance_commands(fx, clean: bool = True) -> DataFrame:
    """One request per request_seq: path parameters (hotel, employee) plus
    the maintenance item array (empty for a request whose one row has no position)."""
    m = fx.maintenance_requests()
    if clean:
        m = sanitized(m)
    first = F.coalesce("pos", F.lit(0))
    header = (m.groupBy("request_seq")
              .agg(F.min_by("hotel_id", first).alias("hotel_id"),
                   F.min_by("employee_id", first).alias("employee_id")))
    items = m.where(F.col("pos").isNotNull()).select("request_seq", "pos", "room_number", "issue_description",
                                                     "maintenance_date", "maintenance_status")
    return nest(header, items, "maintenance")


def to_json_lines(commands: DataFrame) -> DataFrame:
    """One JSON document per request (the request body as it arrives)."""
    return commands.select(F.to_json(F.struct(*commands.columns)).alias("value"))


def parse_json_lines(lines: DataFrame, schema: T.StructType, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse request bodies with an explicit schema; a body that does not
    parse keeps its text in ``_corrupt_record`` (and is rejected later).
    ``keep``: columns beside the body, which replace those parsed from it."""
    full = T.StructType([*[f for f in schema.fields if f.name not in keep], T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return lines.select(*keep, F.from_json(F.col(column), full, options).alias("c")).select(*keep, "c.*")


# -- form bodies -----------------------------------------------------------------
# An array index above this makes the field an object, which the
# schema refuses; a body holds that many fields at most.
FORM_MOST_INDEX = 20
FORM_MOST_FIELDS = 1000


def to_form(commands: DataFrame, items: str, key: str = "request_seq") -> DataFrame:
    """One urlencoded body per request: header fields by name, the fields of
    the n-th item as ``items[n][field]``; NULLs are left out."""
    def pair(name: list[Column], value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(*name, F.lit("="), F.url_encode(value.cast("string"))))

    def named(text: str) -> Column:
        return F.url_encode(F.lit(text))

    header = [pair([named(f.name)], F.col(f.name)) for f in commands.schema.fields if f.name not in (key, items)]
    fields = [f.name for f in commands.schema[items].dataType.elementType.fields if f.name != "pos"]
    of_items = F.flatten(F.transform(items, lambda x, i: F.array(*[pair([named(f"{items}["), i.cast("string"), named(f"][{f}]")], x[f]) for f in fields])))
    return commands.select(key, F.array_join(F.concat(F.array(*header), of_items), "&").alias("body"))


def parse_form(bodies: DataFrame, schema: T.StructType, items: str, key: str = "request_seq") -> DataFrame:
    """Urlencoded bodies (``key``, ``body``) as rows of ``schema``, the columns
    that :func:`parse_json_lines` gives: items in index order, numbered from 1.

    A body with a malformed escape, a field given twice, too many fields or too
    high an index is kept in ``_corrupt_record``, its columns NULL.  All of it
    is expressions within the request's row; a body is bounded by its size."""
    def once(value: Column, use) -> Column:
        """``use(value)``, the value computed once a row: a lambda takes it, so it is not written into the row in between."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    at_pattern = f"^{items}\\[([0-9]{{1,6}})\\]\\["

    def indexes(pairs: Column) -> Column:
        found = F.array_distinct(F.transform(pairs, lambda p: F.regexp_extract(p["k"], at_pattern, 1)))
        return F.sort_array(F.array_distinct(F.transform(F.filter(found, lambda i: i != ""), lambda i: i.cast("int"))))

    def bad(pairs: Column, at: Column) -> Column:
        return F.coalesce(F.exists(pairs, lambda p: p["k"].isNull() | p["v"].isNull()) | (F.size(F.array_distinct(pairs["k"])) < F.size(pairs))
                          | (F.size(pairs) > FORM_MOST_FIELDS) | (F.coalesce(F.array_max(at), F.lit(0)) > FORM_MOST_INDEX), F.lit(True))

    def value(f: T.StructField, fields: Column, at: Column) -> Column:
        if f.name != items:
            return fields[f.name].cast(f.dataType)
        parts = [x for x in f.dataType.elementType.fields if x.name != "pos"]
        names = {x.name: F.array(*[F.lit(f"{items}[{i}][{x.name}]") for i in range(FORM_MOST_INDEX + 1)]) for x in parts}
        return F.transform(at, lambda i, n: F.struct((n + 1).cast("long").alias("pos"), *[fields[F.get(names[x.name], i)].cast(x.dataType).alias(x.name) for x in parts]))

    def command(pairs: Column, at: Column) -> Column:
        return F.when(~bad(pairs, at), once(F.map_from_entries(pairs), lambda m: F.struct(*[value(f, m, at).alias(f.name) for f in schema.fields if f.name != key])))

    halves = F.transform(F.filter(F.split("body", "&"), lambda p: p != ""), lambda p: F.split(p, "=", 2))
    pairs = F.transform(halves, lambda h: F.struct(F.try_url_decode(h[0]).alias("k"), F.try_url_decode(F.coalesce(F.get(h, F.lit(1)), F.lit(""))).alias("v")))
    rows = bodies.select(key, "body", once(pairs, lambda ps: once(indexes(ps), lambda at: command(ps, at))).alias("c"))
    return rows.select(*[F.col(key) if f.name == key else F.col("c")[f.name].alias(f.name) for f in schema.fields], F.when(F.col("c").isNull(), F.col("body")).alias("_corrupt_record"))


def read_command_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Request bodies from JSON-lines files (one document per line)."""
    full = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return (spark.read.schema(full)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(path))
