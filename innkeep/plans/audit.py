"""``audit_constraints``: the DDL's constraints checked over whole tables.

Per table, every constraint on a row is one ``count_if`` of a single aggregate
pass, unpivoted into (table_name, constraint_name, violations) rows.  UNIQUE and
foreign keys start from the rows counted per key, which the tasks add up before
the shuffle: a unique column's violations are the counts above one, a foreign
key's are the counts of the keys that an anti-join with the parent's distinct
keys leaves.  So no whole row is shuffled, and a key with a third of all rows is
one row a task.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.session import materialize

ROWS_A_TASK = 250_000         # table rows for each shuffle partition of the audit

# The constraints of the ten table definitions (UNIQUE, NOT
# NULL, VARCHAR lengths, CHECK, ENUM, FOREIGN KEY), on the column names the
# code uses (cancel_reason; maintenance keyed by hotel_id/room_number).
CONSTRAINTS = [
    ("hotels", "unique", ("hotel_id",)),
    ("hotels", "not_null", ("hotel_id",)),
    ("hotels", "varchar", ("hotel_id", 20)),
    ("hotels", "not_null", ("hotel_name",)),
    ("hotels", "varchar", ("hotel_name", 255)),
    ("hotels", "varchar", ("city", 100)),
    ("hotels", "varchar", ("country", 100)),
    ("hotels", "check", ("star_rating", 1, 5)),
    ("rooms", "unique", ("room_id",)),
    ("rooms", "not_null", ("room_id",)),
    ("rooms", "varchar", ("room_id", 20)),
    ("rooms", "not_null", ("hotel_id",)),
    ("rooms", "varchar", ("hotel_id", 20)),
    ("rooms", "varchar", ("room_number", 10)),
    ("rooms", "not_null", ("room_type",)),
    ("rooms", "enum", ("room_type", ("Deluxe", "Suite", "Standard"))),
    ("rooms", "fk", (("hotel_id",), "hotels", ("hotel_id",))),
    ("services", "unique", ("service_id",)),
    ("services", "not_null", ("service_id",)),
    ("services", "varchar", ("service_id", 20)),
    ("services", "not_null", ("hotel_id",)),
    ("services", "varchar", ("hotel_id", 20)),
    ("services", "varchar", ("service_name", 100)),
    ("services", "fk", (("hotel_id",), "hotels", ("hotel_id",))),
    ("customers", "unique", ("customer_id",)),
    ("customers", "not_null", ("customer_id",)),
    ("customers", "varchar", ("customer_id", 20)),
    ("customers", "not_null", ("full_name",)),
    ("customers", "varchar", ("full_name", 255)),
    ("customers", "unique", ("email",)),
    ("customers", "varchar", ("email", 255)),
    ("customers", "varchar", ("phone", 20)),
    ("customers", "varchar", ("city", 100)),
    ("customers", "varchar", ("country", 100)),
    ("employees", "unique", ("employee_id",)),
    ("employees", "not_null", ("employee_id",)),
    ("employees", "varchar", ("employee_id", 20)),
    ("employees", "not_null", ("hotel_id",)),
    ("employees", "varchar", ("hotel_id", 20)),
    ("employees", "varchar", ("full_name", 255)),
    ("employees", "varchar", ("role", 100)),
    ("employees", "fk", (("hotel_id",), "hotels", ("hotel_id",))),
    ("bookings", "unique", ("booking_id",)),
    ("bookings", "not_null", ("booking_id",)),
    ("bookings", "varchar", ("booking_id", 20)),
    ("bookings", "not_null", ("customer_id",)),
    ("bookings", "varchar", ("customer_id", 20)),
    ("bookings", "not_null", ("hotel_id",)),
    ("bookings", "varchar", ("hotel_id", 20)),
    ("bookings", "enum", ("booking_status", ("Confirmed", "Cancelled"))),
    ("bookings", "fk", (("customer_id",), "customers", ("customer_id",))),
    ("bookings", "fk", (("hotel_id",), "hotels", ("hotel_id",))),
    ("booking_rooms", "unique", ("booking_room_id",)),
    ("booking_rooms", "not_null", ("booking_room_id",)),
    ("booking_rooms", "varchar", ("booking_room_id", 20)),
    ("booking_rooms", "not_null", ("booking_id",)),
    ("booking_rooms", "varchar", ("booking_id", 20)),
    ("booking_rooms", "not_null", ("room_number",)),
    ("booking_rooms", "varchar", ("room_number", 20)),
    ("booking_rooms", "fk", (("booking_id",), "bookings", ("booking_id",))),
    ("bookings_cancelled", "unique", ("booking_cancel_id",)),
    ("bookings_cancelled", "not_null", ("booking_cancel_id",)),
    ("bookings_cancelled", "varchar", ("booking_cancel_id", 20)),
    ("bookings_cancelled", "not_null", ("booking_id",)),
    ("bookings_cancelled", "varchar", ("booking_id", 20)),
    ("bookings_cancelled", "not_null", ("customer_id",)),
    ("bookings_cancelled", "varchar", ("customer_id", 20)),
    ("bookings_cancelled", "not_null", ("hotel_id",)),
    ("bookings_cancelled", "varchar", ("hotel_id", 20)),
    ("bookings_cancelled", "fk", (("customer_id",), "customers", ("customer_id",))),
    ("bookings_cancelled", "fk", (("hotel_id",), "hotels", ("hotel_id",))),
    ("reviews", "unique", ("review_id",)),
    ("reviews", "not_null", ("review_id",)),
    ("reviews", "varchar", ("review_id", 20)),
    ("reviews", "not_null", ("hotel_id",)),
    ("reviews", "not_null", ("customer_id",)),
    ("reviews", "check", ("rating", 1, 5)),
    ("reviews", "fk", (("hotel_id",), "hotels", ("hotel_id",))),
    ("reviews", "fk", (("customer_id",), "customers", ("customer_id",))),
    ("maintenance", "unique", ("maintenance_id",)),
    ("maintenance", "not_null", ("maintenance_id",)),
    ("maintenance", "varchar", ("maintenance_id", 20)),
    ("maintenance", "fk", (("hotel_id", "room_number"), "rooms", ("hotel_id", "room_number"))),
]


def constraint_name(kind: str, args) -> str:
    if kind == "fk":
        return f"fk({','.join(args[0])})->{args[1]}"
    if kind == "check":
        return f"check({args[0]} between {args[1]} and {args[2]})"
    if kind == "enum":
        return f"enum({args[0]})"
    if kind == "varchar":
        return f"varchar({args[0]},{args[1]})"
    return f"{kind}({args[0]})"


def _violation_expr(kind: str, args):
    c = F.col(args[0])
    if kind == "not_null":
        return F.count_if(c.isNull())
    if kind == "check":
        return F.count_if(c.isNotNull() & ~c.between(args[1], args[2]))
    if kind == "enum":
        return F.count_if(c.isNotNull() & ~c.isin(*args[1]))
    if kind == "varchar":
        # VARCHAR(n) counts characters (code points), not UTF-16 units
        return F.count_if(F.length(c) > args[1])
    raise ValueError(kind)


def _key(cols) -> Column:
    """A key of one or more columns as text; NULL if any is (MATCH SIMPLE)."""
    text = [F.col(c).cast("string") for c in cols]
    if len(text) == 1:
        return text[0]
    present = F.lit(True)
    for c in text:
        present = present & c.isNotNull()
    return F.when(present, F.to_json(F.array(*text)))


def _keys(df: DataFrame, wanted: list[tuple[int, tuple]]) -> DataFrame:
    """(no, key) of every row for each numbered key."""
    each = F.array(*[F.struct(F.lit(no).alias("no"), _key(cols).alias("key")) for no, cols in wanted])
    return df.select(F.inline(each)).where("key IS NOT NULL")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@contextmanager
def _more_partitions(spark, rows: int):
    """Shuffles run in here have a partition per ``ROWS_A_TASK`` of ``rows`` at
    least, so a task's share does not grow with the tables (small partitions
    are merged again)."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), -(-rows // ROWS_A_TASK))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _key_violations(fx) -> DataFrame:
    """UNIQUE and FOREIGN KEY: each table is read once for all its keys, and
    all keys are counted, and met by the parents' keys, in one join."""
    numbered = [(no, t, k, a) for no, (t, k, a) in enumerate(CONSTRAINTS) if k in ("fk", "unique")]
    own, parents = {}, {}
    for no, t, kind, args in numbered:
        own.setdefault(t, []).append((no, tuple(args) if kind == "unique" else args[0]))
        if kind == "fk":
            parents.setdefault(args[1], []).append((no, args[2]))
    counts = _union([_keys(fx.table(t), w) for t, w in own.items()]).groupBy("no", "key").agg(F.count(F.lit(1)).alias("_rows"))
    known = _union([_keys(fx.table(t), w) for t, w in parents.items()]).distinct().withColumn("_known", F.lit(True))
    is_unique = F.col("no").isin(*[no for no, _, k, _ in numbered if k == "unique"])
    wrong = F.when(is_unique, F.col("_rows") - 1).when(F.col("_known").isNull(), F.col("_rows")).otherwise(0)
    found = counts.join(known, ["no", "key"], "left").groupBy("no").agg(F.sum(wrong).alias("violations"))
    names = fx.spark.createDataFrame([(no, t, constraint_name(k, a)) for no, t, k, a in numbered], "no int, table_name string, constraint_name string")
    return (names.join(found, "no", "left")
            .select("table_name", "constraint_name", F.coalesce("violations", F.lit(0)).cast("long").alias("violations")))


def audit(fx) -> DataFrame:
    """(table_name, constraint_name, violations) of every constraint, computed
    here with as many shuffle partitions as the tables' rows need."""
    tables = list(dict.fromkeys(t for t, _, _ in CONSTRAINTS))
    parts = []
    for t in tables:
        of_rows = [(k, a) for tt, k, a in CONSTRAINTS if tt == t and k not in ("fk", "unique")]
        row = fx.table(t).agg(*[_violation_expr(k, a).cast("long").alias(f"c{i}") for i, (k, a) in enumerate(of_rows)])
        entries = F.array(*[F.struct(F.lit(constraint_name(k, a)).alias("constraint_name"), F.col(f"c{i}").alias("violations"))
                            for i, (k, a) in enumerate(of_rows)])
        parts.append(row.select(F.lit(t).alias("table_name"), F.inline(entries)))
    with _more_partitions(fx.spark, sum(fx.table(t).count() for t in tables)):
        return materialize(_union([*parts, _key_violations(fx)]))


def audit_sql() -> str:
    sel = []
    for t, k, a in CONSTRAINTS:
        name = constraint_name(k, a).replace("'", "''")
        if k == "unique":
            v = f"COUNT({a[0]}) - COUNT(DISTINCT {a[0]})"
        elif k == "not_null":
            v = f"COUNT(*) FILTER (WHERE {a[0]} IS NULL)"
        elif k == "check":
            v = f"COUNT(*) FILTER (WHERE {a[0]} IS NOT NULL AND NOT ({a[0]} BETWEEN {a[1]} AND {a[2]}))"
        elif k == "enum":
            vals = ", ".join(f"'{x}'" for x in a[1])
            v = f"COUNT(*) FILTER (WHERE {a[0]} IS NOT NULL AND {a[0]} NOT IN ({vals}))"
        elif k == "varchar":
            v = f"COUNT(*) FILTER (WHERE length({a[0]}) > {a[1]})"
        else:
            cols, parent, pcols = a
            cond = " AND ".join(f"p.{pc} = x.{c}" for c, pc in zip(cols, pcols))
            nn = " AND ".join(f"x.{c} IS NOT NULL" for c in cols)
            sel.append(f"SELECT '{t}' AS table_name, '{name}' AS constraint_name, "
                       f"CAST(COUNT(*) AS BIGINT) AS violations FROM {t} x WHERE ({nn}) AND NOT EXISTS "
                       f"(SELECT 1 FROM {parent} p WHERE {cond})")
            continue
        sel.append(f"SELECT '{t}' AS table_name, '{name}' AS constraint_name, CAST({v} AS BIGINT) AS violations "
                   f"FROM {t}")
    return "\nUNION ALL\n".join(sel)
