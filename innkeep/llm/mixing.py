"""Mixing sources to target weights, with DataFrame functions only.

Targets: the words of all documents are shared among the sources by weight; a
source's target stops at ``max_epochs`` times its words and the excess is
shared again by weight (water filling, in closed form over the sources sorted
by the level at which they stop).

Within a source the mix takes complete epochs first.  What is left of the
target is a fraction of an epoch: documents are sorted by Efraimidis-Spirakis
keys ``-ln(u) / quality`` (u from the MD5 of the id, so reruns agree) and
taken while the middle of a document's stretch of the running sum lies within
the rest, so a source misses its target by half a document at most.

No source is sorted in one task.  Keys are cut into ranges; range sums are
added up per source; the one range in which the rest runs out is cut into
ranges again, until it holds ``RANGE_ROWS`` different documents at most, and only
that one is sorted.  Rows alike in doc_id, size and source are one row with a
count there.  A document is then taken if its key lies below its source's
threshold, which is one comparison per row against a table of one row per
source; of rows alike at the threshold as many are taken as fit, told apart by
their place in their partition after the counts of earlier ones.

Defined results: a null text has size 0; a null source is a source, last in
order; a null doc_id takes its random number from its text; of rows alike in
doc_id, size and source any may be taken and the others left; an empty table
gives no rows; further columns are kept by ``mixed_documents`` and not carried by
``mix``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innkeep.llm.common import free_name, materialize

WEIGHTS = (1, 2, 3)          # by source, in code point order, repeating
MAX_EPOCHS = 3
RANGE_ROWS = 8192
PLACES = 1 << 52             # places of a key, cut into ranges
BROADCAST_SOURCES = 50_000   # rows; above, the source table is joined without a hint
#: document quality as a sampling weight: labelled good, labelled poor, not labelled (fixed values)
GOOD, POOR, UNKNOWN = 1.0, 0.25, 0.5
_WHITE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of maximal runs outside U+0020 and U+0009 to U+000D; 0 for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WHITE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def label_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, quality weight) of the labelled documents."""
    return (labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
            .select("doc_id", F.when(F.col("q") == 1, GOOD).when(F.col("q") == 0, POOR).otherwise(UNKNOWN).alias("quality")))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number strictly between 0 and 1 from 52 bits of an MD5."""
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    bits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source of (source, source_size): target, epochs, rest.

    One row per source passes through one task here, as the weights depend on
    the order of all source names."""
    every = Window.orderBy("source_null", "source")
    weighted = (sizes.withColumn("source_null", F.col("source").isNull())
                .withColumn("rank", F.row_number().over(every))
                .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") - 1) % len(WEIGHTS) + 1).cast("long"))
                .withColumn("cap", F.col("source_size") * max_epochs))
    unit = 1
    for w in WEIGHTS:
        unit *= w
    up = Window.orderBy((F.col("cap") * F.lit(unit) / F.col("weight")), "rank")
    whole = Window.partitionBy()
    filled = (weighted
              .withColumn("all_words", F.sum("source_size").over(whole))
              .withColumn("cap_before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("weight_left", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("stopped", F.col("cap") * F.col("weight_left") <= (F.col("all_words") - F.col("cap_before")) * F.col("weight"))
              .withColumn("words_left", F.col("all_words") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(whole), F.lit(0)))
              .withColumn("weight_open", F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(whole)))
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(
        (F.col("words_left") * F.col("weight")).cast("double") / F.col("weight_open"))
    epochs = F.when(F.col("source_size") == 0, 0).when(F.col("stopped"), max_epochs).otherwise(
        F.floor(F.col("target") / F.col("source_size")))
    return (filled.withColumn("target", target).withColumn("epochs", epochs.cast("long"))
            .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
            .select("source", "source_size", "target", "epochs", "rest"))


def _join_sources(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    per = sources.withColumnRenamed("source", "_source")
    per = F.broadcast(per) if n <= BROADCAST_SOURCES else per
    return rows.join(per, rows["source"].eqNullSafe(per["_source"])).drop("_source")


def _keyed(docs: DataFrame, quality: DataFrame | None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text")).alias("u"))
    return _with_key(rows, quality)


def _with_key(rows: DataFrame, quality: DataFrame | None) -> DataFrame:
    if quality is None:
        return rows.withColumn("key", -F.log("u") / UNKNOWN).drop("u")
    weights = quality.select(F.col("doc_id").alias("_labelled"), F.col("quality").alias("_quality"))
    return (rows.join(weights, rows["doc_id"] == weights["_labelled"], "left")
            .withColumn("key", -F.log("u") / F.coalesce("_quality", F.lit(UNKNOWN))).drop("u", "_labelled", "_quality"))


def _decide(rows: DataFrame, max_epochs: int) -> tuple[DataFrame, int]:
    """(per source: targets and threshold, number of sources).  ``rows`` is a
    checkpointed table of doc_id, source, size, key.

    The threshold is the last (key, doc_id, size) that is taken, and how many
    of the rows alike in it are."""
    per_source = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")))
    size_of = per_source.agg(F.count(F.lit(1)), F.max("_rows")).first()
    n, ranges = size_of[0], -(-(size_of[1] or 1) // RANGE_ROWS)
    targets = materialize(source_targets(per_source.drop("_rows"), max_epochs))
    # the stretch of places in which a source's rest runs out, and the words before it
    bounds = targets.select("source", "rest", F.lit(0).cast("long").alias("lo"), F.lit(PLACES).alias("hi"), F.lit(0).cast("long").alias("before"))
    place, wide = key_place(F.col("key")), F.ceil((F.col("hi") - F.col("lo")) / F.lit(ranges)).cast("long")
    while True:
        ranged = (_join_sources(rows, bounds, n).filter((place >= F.col("lo")) & (place < F.col("hi")))
                  .withColumn("range", F.floor((place - F.col("lo")) / wide).cast("long")))
        sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("earlier", F.coalesce(F.sum("words").over(running), F.lit(0)))
        last = (_join_sources(sums, bounds, n).filter(F.col("before") + F.col("earlier") <= F.col("rest")).groupBy("source")
                .agg(F.max(F.struct("range", (F.col("before") + F.col("earlier")).alias("before"), "rows", "lo", "hi", "rest")).alias("s")).select("source", "s.*"))
        bounds = materialize(last.select("source", "rest", (F.col("lo") + wide * F.col("range")).alias("lo"),
                                         F.least("hi", F.col("lo") + wide * (F.col("range") + 1)).alias("hi"),
                                         F.col("before").cast("long").alias("before"), "rows"))
        most = bounds.filter("hi - lo > 1").agg(F.max("rows")).first()[0]
        if (most or 0) <= RANGE_ROWS:
            break
        ranges = max(2, min(1024, -(-most // RANGE_ROWS)))
        bounds, wide = bounds.drop("rows"), F.ceil((F.col("hi") - F.col("lo")) / F.lit(ranges)).cast("long")
    spot = key_place(F.col("key"))
    inside = (_join_sources(rows, bounds.drop("rows"), n).filter((spot >= F.col("lo")) & (spot < F.col("hi")))
              .groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("alike"), F.first("before").alias("before"), F.first("rest").alias("rest")))
    in_order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("alike")).over(in_order), F.lit(0))
    # the middle of the i-th row alike lies at upto + (i - 1/2) * size
    fit = F.when(F.col("size") == 0, F.col("alike")).otherwise(F.floor((F.col("rest") - F.col("upto")) / F.col("size") + 0.5))
    limit = (inside.withColumn("upto", upto).filter(F.col("upto") + F.col("size") / 2.0 <= F.col("rest")).groupBy("source")
             .agg(F.max(F.struct("key", "doc_id", "size", F.least(F.col("alike"), fit).cast("long").alias("alike"))).alias("limit")))
    ends = bounds.select(F.col("source").alias("_s"), "lo").join(limit.withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t")
    return materialize(targets.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")), n


def key_place(key: Column) -> Column:
    """A key's place, a whole number below ``PLACES`` that rises with the key;
    about even for keys of documents without a label."""
    return F.least(F.floor((F.lit(1.0) - F.exp(key * F.lit(-UNKNOWN))) * PLACES), F.lit(PLACES - 1)).cast("long")


def _numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with a number from 1 within their keys, in no stated order: a
    place among the rows of one partition, after the counts of earlier ones."""
    pid, mid, before = (free_name(c, [*rows.columns, name]) for c in ("_pid", "_mid", "_before"))
    fixed = materialize(rows.withColumn(pid, F.spark_partition_id()).withColumn(mid, F.monotonically_increasing_id()))
    earlier = Window.partitionBy(*keys).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    counts = fixed.groupBy(pid, *keys).agg(F.count(F.lit(1)).alias("n")).withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    theirs = {c: free_name(f"_of_{c}", [*rows.columns, name, pid, mid, before]) for c in [pid, *keys]}
    counts = counts.select(*[F.col(c).alias(t) for c, t in theirs.items()], before)
    same = F.lit(True)
    for c, t in theirs.items():
        same &= F.col(c).eqNullSafe(F.col(t))
    number = F.row_number().over(Window.partitionBy(pid, *keys).orderBy(mid))
    return (fixed.withColumn(name, number).join(counts, same).withColumn(name, F.col(name) + F.col(before))
            .select(*[F.col(c) for c in rows.columns], name))


def _chosen(rows: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """``rows`` with source_size, target and copies."""
    place = key_place(F.col("key"))
    own = F.struct("key", "doc_id", "size")
    limit = F.struct("limit.key", "limit.doc_id", "limit.size")
    known = F.col("limit").isNotNull()
    # below the stretch in which the rest runs out, or in it and below the threshold
    below = F.coalesce((place < F.col("lo")) | known & (own < limit), F.lit(False))
    at = F.coalesce(known & own.eqNullSafe(limit), F.lit(False))
    joined = _join_sources(rows, targets, n).withColumn("_below", below).withColumn("_at", at)
    tied = _numbered(joined.filter("_at"), ["source"], "_number").withColumn("_below", F.col("_number") <= F.col("limit.alike"))
    both = joined.filter("not _at").unionByName(tied.select(*joined.columns))
    return (both.withColumn("copies", (F.col("epochs") + F.when((F.col("rest") > 0) & F.col("_below"), 1).otherwise(0)).cast("long"))
            .drop("epochs", "rest", "lo", "limit", "_below", "_at"))


def mix(docs: DataFrame, quality: DataFrame | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every
    document.  ``quality`` has unique doc_id and a positive weight up to 1."""
    rows = materialize(_keyed(docs, quality))
    return (_chosen(rows, *_decide(rows, max_epochs))
            .withColumn("taken", F.col("size") * F.col("copies"))
            .select("doc_id", "source", "size", "source_size", "target", "copies", "taken"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: every row of ``docs``, all its columns, as often as it
    is taken (rows of size 0 are in complete epochs only)."""
    rows = materialize(_keyed(docs, quality))
    decided = _chosen(rows, *_decide(rows, max_epochs)).select("doc_id", "source", "size", "key", "copies")
    # rows alike have one row here: the copies that each has, and how many of them have one more
    decided = materialize(decided.groupBy("doc_id", "source", "size", "key")
                          .agg(F.min("copies").alias("copies"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("more")).filter("copies > 0 or more > 0"))
    names = {c: free_name(f"_mix_{c}", docs.columns) for c in ("id", "source", "size", "copies", "more", "u", "of_u", "number")}
    by_id = decided.select(F.col("doc_id").alias(names["id"]), F.col("source").alias(names["source"]), F.col("size").alias(names["size"]),
                           F.col("copies").alias(names["copies"]), F.col("more").alias(names["more"]), F.col("key").alias(names["u"]))
    with_size = docs.withColumn(names["of_u"], word_count(F.col("text")))
    known = F.col("doc_id").cast("long") == F.col(names["id"])
    more = F.col("source").cast("string").eqNullSafe(F.col(names["source"])) & (F.col(names["of_u"]) == F.col(names["size"]))
    columns = [*docs.columns, *(names[c] for c in ("copies", "more", "id", "source", "size", "u"))]
    joined = with_size.join(by_id, known & more).select(*columns)
    unnamed = docs.filter(F.col("doc_id").isNull())
    if unnamed.head(1):                                      # rows without id: the key tells them apart, by their text
        u = -F.log(uniform(F.col("doc_id"), F.col("text"))) / UNKNOWN
        other = (unnamed.withColumn(names["of_u"], u)
                 .join(by_id.filter(F.col(names["id"]).isNull()),
                       (F.col(names["of_u"]) == F.col(names["u"])) & F.col("source").cast("string").eqNullSafe(F.col(names["source"]))))
        joined = joined.unionByName(other.select(*columns))
    some = F.col(names["more"]) > 0
    if decided.filter("more > 0").head(1):                   # rows alike at a source's threshold, not all of them taken
        partly = _numbered(joined.filter(some), [names[c] for c in ("id", "source", "size", "u")], names["number"])
        partly = partly.withColumn(names["copies"], F.col(names["copies"]) + (F.col(names["number"]) <= F.col(names["more"])).cast("long"))
        joined = joined.filter(~some).unionByName(partly.select(*columns))
    return (joined.filter(F.col(names["copies"]) > 0)
            .withColumn(names["copies"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["copies"]))))
            .select(*docs.columns))


#: the same rows in DuckDB's SQL, from the tables documents and labels
MIX_SQL = r"""
WITH quality AS (
  SELECT doc_id, CASE max(quality) WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS q
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
rows_ AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5)
        / 4503599627370496.0::DOUBLE) / coalesce(q.q, 0.5::DOUBLE) AS key
  FROM documents d LEFT JOIN quality q ON d.doc_id = q.doc_id),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
    1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS weight,
    row_number() OVER (ORDER BY source IS NULL, source) AS rank
  FROM rows_ GROUP BY source),
filling AS (
  SELECT *, sum(source_size) OVER () AS all_words,
    coalesce(sum(cap) OVER (ORDER BY cap * 6 // weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(weight) OVER (ORDER BY cap * 6 // weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM sources),
stopping AS (SELECT *, cap * weight_left <= (all_words - cap_before) * weight AS stopped FROM filling),
level AS (
  SELECT *, all_words - coalesce(sum(cap) FILTER (stopped) OVER (), 0) AS words_left,
    sum(weight) FILTER (NOT stopped) OVER () AS weight_open FROM stopping),
targets AS (
  SELECT source, source_size, stopped,
    CASE WHEN stopped THEN cap::DOUBLE ELSE (words_left * weight)::DOUBLE / weight_open::DOUBLE END AS target FROM level),
epochs AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN stopped THEN 3 ELSE floor(target / source_size::DOUBLE)::BIGINT END AS epochs FROM targets),
summed AS (
  SELECT r.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id NULLS FIRST, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows_ r JOIN epochs e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""
