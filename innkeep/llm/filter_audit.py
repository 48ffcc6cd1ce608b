"""Interaction of document filters, by recursive enumeration of their orders.

Every document gets a mask of the filters it fails, and documents are counted
per (part, mask): at most 2^k cells a part, whatever the corpus.  A recursive
common table expression then extends prefixes of filters with the letters not
in them yet.  Each level joins the part's mask cells to the prefixes, carries
the bits applied so far, and emits the metrics of the step it has just added;
the last level holds every order with the metrics of all its steps.

Only the masks read texts.  Equal texts are found by SHA-256, so that no text
is shuffled; the first of each is joined back from a table with one row a
text, which Spark can split when one text has a large share of all rows.

Defined results: a null text is empty; a null or empty language is part '';
rows without doc_id neither have nor are a smaller copy; rows that repeat a
doc_id count once each and are no copies of one another; a document has a
label if any of its label rows says so; labels without doc_id count nowhere;
an empty table gives no rows; further columns, whatever their names, are not
carried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import materialize

LETTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50            # percent of the words
MOST_CAPITALS = 3              # percent of the code points
SYMBOLS = "[#$%&*|]"
_SPACE = " \t\n\x0b\f\r"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < LEAST_WORDS,
            "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
            "C": 100 * capitals > MOST_CAPITALS * F.length(text),
            "D": text.rlike(SYMBOLS)}


def _bits(failed: dict[str, Column], letters: str) -> Column:
    out = F.lit(0)
    for letter, fails in failed.items():
        out = out.bitwiseOR(F.when(fails, 1 << letters.index(letter)).otherwise(0))
    return out


def document_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every row; bit i of the mask is filter ``LETTERS[i]``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       text.alias("text"))
    rows = materialize(rows.select("doc_id", "part", _bits(text_failures(F.col("text")), LETTERS).alias("mask"),
                                   F.unhex(F.sha2("text", 256)).alias("same")))
    first = materialize(rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
                        .filter("n > 1 and first is not null").select("same", "first"))
    return rows.join(first, "same", "left").select(
        "doc_id", "part", F.col("mask").bitwiseOR(F.when(F.col("doc_id") > F.col("first"), 1 << LETTERS.index("E")).otherwise(0)).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the counts n, good (quality 1), toxic (toxic 1) of ``masks``
    (doc_id, part, mask)."""
    flags = materialize(labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    # a row without doc_id has no labels, and all of them would meet in one task
    marked = (masks.filter("doc_id is not null").join(flags, "doc_id", "left").select("part", "mask", "good", "toxic")
              .unionByName(masks.filter("doc_id is null").select("part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))))
    return marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).cast("long").alias("good"),
                                              F.sum(F.coalesce("toxic", F.lit(0))).cast("long").alias("toxic"))


_STEP = "named_struct('letter', l.letter, {})".format(", ".join(
    f"'{name}', aggregate(filter(c.cells, x -> {where}), 0L, (a, x) -> a + x.{what})" for name, what, where in (
        ("kept", "n", "x.mask & (w.applied | l.bit) = 0"),
        ("removed", "n", "x.mask & w.applied = 0 AND x.mask & l.bit <> 0"),
        ("redundant", "n", "x.mask & w.applied <> 0 AND x.mask & l.bit <> 0"),
        ("unique_fails", "n", "x.mask = l.bit"),
        ("good_lost", "good", "x.mask & w.applied = 0 AND x.mask & l.bit <> 0"),
        ("toxic_lost", "toxic", "x.mask & w.applied = 0 AND x.mask & l.bit <> 0"))))
_STEP_TYPE = "array<struct<letter:string,kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,good_lost:bigint,toxic_lost:bigint>>"

#: prefixes of filters: the letters of the next level are those whose bit is not applied
WALK_SQL = f"""
WITH RECURSIVE walk(part, prefix, applied, steps) AS (
    SELECT part, '', 0, CAST(array() AS {_STEP_TYPE}) FROM {{cells}}
    UNION ALL
    SELECT w.part, concat(w.prefix, l.letter), w.applied | l.bit, CAST(concat(w.steps, array({_STEP})) AS {_STEP_TYPE})
    FROM (SELECT *, explode(filter(transform(sequence(1, {{n}}), i -> named_struct('letter', substr({{letters}}, i, 1), 'bit', shiftleft(1, i - 1))),
                                   f -> applied & f.bit = 0)) AS l FROM walk) w
    JOIN {{cells}} c ON c.part = w.part
)
SELECT part, prefix AS filter_order, posexplode(steps) AS (at, s) FROM walk WHERE length(prefix) = {{n}}
"""


def audit_orders(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Metrics of every step of every order of ``letters`` in every part of
    ``cells`` (part, mask, n, good, toxic).

    The recursion starts from one row a part, with its cells (2^k at most) in
    an array.  Its rows are parts times prefixes, so Spark's bound on them is
    lifted for this statement."""
    spark = cells.sparkSession
    parts = materialize(cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))
    rows = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "-1")
    try:
        walk = materialize(spark.sql(WALK_SQL, cells=parts, letters=letters, n=len(letters)).select("part", "filter_order", (F.col("at") + 1).alias("step"), "s.*"))
    finally:
        spark.conf.set(rows, before)
    # per part and letter: the sum over all orders, whatever the step
    shapley = walk.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return walk.join(shapley, ["part", "letter"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails",
        "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over all documents: one row per part, order and step."""
    return audit_orders(materialize(mask_cells(document_masks(docs), labels)))


AUDIT_SQL = r"""
WITH RECURSIVE flags AS (
    SELECT doc_id, MAX(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, MAX(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
    SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS t,
           regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w,
           MIN(doc_id) OVER (PARTITION BY COALESCE(text, '')) AS first
    FROM documents
), m AS (
    SELECT doc_id, part,
           (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN doc_id > first THEN 16 ELSE 0 END) AS mask
    FROM d
), cells AS (
    SELECT part, mask, COUNT(*) AS n, SUM(COALESCE(good, 0)) AS good, SUM(COALESCE(toxic, 0)) AS toxic
    FROM m LEFT JOIN flags USING (doc_id) GROUP BY part, mask
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
walk(prefix, letter, bit, before, applied) AS (
    SELECT '', '', 0, 0, 0
    UNION ALL
    SELECT prefix || l.letter, l.letter, l.bit, applied, applied + l.bit FROM walk JOIN letters l ON (applied & l.bit) = 0
), steps AS (
    SELECT part, prefix, length(prefix) AS step, walk.letter,
           SUM(CASE WHEN (mask & applied) = 0 THEN n ELSE 0 END) AS kept,
           SUM(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN n ELSE 0 END) AS removed,
           SUM(CASE WHEN (mask & before) <> 0 AND (mask & bit) <> 0 THEN n ELSE 0 END) AS redundant,
           SUM(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
           SUM(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN good ELSE 0 END) AS good_lost,
           SUM(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM walk, cells WHERE prefix <> '' GROUP BY ALL
), rows AS (
    SELECT s.*, o.prefix AS filter_order FROM steps s JOIN (SELECT prefix FROM walk WHERE length(prefix) = 5) o ON starts_with(o.prefix, s.prefix)
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM rows
"""
