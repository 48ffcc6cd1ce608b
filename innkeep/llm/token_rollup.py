"""Token counts as a delta-maintained rollup.

State is a folder of committed batches.  A batch turns changes of documents
into signed rows: an insert adds the document's count, a delete takes back
what is counted for it, a revision does both, under the tokenizer version it
names.  Each batch writes its signed rows per document (``ledger``) and then
their sums by source, language and tokenizer version (``totals``).  Totals are
additive: the rollup is the sum over batches, and no document is counted again.

A delta pays for itself.  The ledger lies in hash buckets of the document key;
a batch's changes are written once, in the same buckets, and only the buckets
they touch are read.  Of these, rows of other documents fall out in a semi-join
with the batch's keys (a broadcast where Spark measures them small) before
anything is grouped.  ``compact`` replaces the ledgers of all batches so far by
one row per counted document, so that history does not add up; totals are never
compacted and remain the record of what is committed.

A batch is committed once Spark has marked its totals as complete, which is its
last step.  Committing a batch id again does nothing; one that broke off before
is written anew from the start.

Defined results: a null text counts 0 tokens; documents without doc_id are told
apart by their text; an insert of a counted document revises it; deletes and
revisions of documents that are not counted do nothing; of several changes of
one document in a batch the last ``kind`` in the order delete, revise, insert
holds (ties: the largest values); null sources and languages are groups;
groups without documents are not reported; an empty batch commits nothing but
itself; very long texts are counted whole; further columns, whatever their
names, are not carried."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.llm.tokenizing import token_ids

#: tokenizer versions by name: files of the public tokenizers (fixed values)
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.json", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken"}
_LEDGER = "key string, source string, lang string, version string, documents long, tokens long, bucket int"
_CHANGES = "key string, kind string, tokens long, source string, lang string, version string, bucket int"
_TOTALS = "source string, lang string, version string, documents long, tokens long"


def counted(docs: DataFrame, kind: str, version: str, tokenizer: str | None = None) -> DataFrame:
    """Changes of ``kind`` insert or revise, with the whole texts' counts."""
    file = tokenizer or VERSIONS[version]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(token_ids(t.as_py() or "", file)) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], names=["key", "source", "lang", "tokens"])

    rows = docs.select(document_key().alias("key"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return (rows.mapInArrow(run, "key string, source string, lang string, tokens long")
            .select(F.lit(kind).alias("kind"), "key", "source", "lang", F.lit(version).alias("version"), "tokens"))


def deleted(docs: DataFrame) -> DataFrame:
    """Changes that take documents out of the counts."""
    nothing = F.lit(None).cast("string")
    return docs.select(F.lit("delete").alias("kind"), document_key().alias("key"), nothing.alias("source"), nothing.alias("lang"),
                       nothing.alias("version"), F.lit(0).cast("long").alias("tokens"))


def document_key():
    return F.coalesce(F.col("doc_id").cast("long").cast("string"),
                      F.concat(F.lit("text:"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))


class TokenRollup:
    """The rollup kept in ``path``, a folder that all executors share.

    Batches are committed one at a time, by one writer.  ``buckets`` is fixed
    when the first batch is committed and read from the folder from then on;
    it bounds what a small delta reads (1 / buckets of the ledger for each key
    at most)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        kept = self._names("layout", "buckets", "")
        self.buckets = int(kept[0]) if kept else buckets

    def _place(self, *parts: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, what: str, column: str, mark: str = "/_SUCCESS") -> list[str]:
        """Values of a folder's ``column=value`` parts, with Spark's mark of a
        complete write if so asked: one call to the store."""
        store, place = self._place(what, f"{column}=*{mark}")
        found = [s.getPath() for s in store.globStatus(place) or []]
        return sorted((p.getParent() if mark else p).getName().removeprefix(f"{column}=") for p in found)

    def committed(self) -> list[str]:
        """Names of the committed batches."""
        return self._names("totals", "batch")

    def has(self, batch: str) -> bool:
        store, place = self._place("totals", f"batch={batch}", "_SUCCESS")
        return store.exists(place)

    def _read(self, what: str, schema: str, names: list[str], column: str = "batch") -> DataFrame:
        paths = [f"{self.path}/{what}/{column}={n}" for n in names]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(f"{schema}, {column} string").option("basePath", f"{self.path}/{what}")
                .parquet(*paths).drop(column))

    def _write(self, rows: DataFrame, *parts: str) -> None:
        """Rows with a key, by bucket; large buckets are several files."""
        bucket = F.pmod(F.hash("key"), F.lit(self.buckets))
        (rows.withColumn("bucket", bucket).hint("rebalance", "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet("/".join((self.path, *parts))))

    def _compacted(self) -> tuple[str | None, list[str]]:
        """The newest complete compaction and the batches it covers."""
        numbers = self._names("covered", "compaction")
        if not numbers:
            return None, []
        newest = max(numbers, key=int)
        return newest, [r.name for r in self.spark.read.schema("name string").parquet(f"{self.path}/covered/compaction={newest}").collect()]

    def _ledger(self) -> DataFrame:
        newest, covered = self._compacted()
        batches = self._read("ledger", _LEDGER, [b for b in self.committed() if b not in set(covered)])
        if newest is None:
            return batches
        return self._read("compacted", _LEDGER, [newest], "compaction").unionByName(batches)

    def current(self, keys: DataFrame | None = None, touched: list[int] | None = None) -> DataFrame:
        """What is counted for each document, or for those of ``keys`` (column
        ``key``), which lie in the buckets ``touched``."""
        rows = self._ledger()
        if touched is not None:
            rows = rows.filter(F.col("bucket").isin(touched))
        if keys is not None:
            rows = rows.join(keys.select("key"), "key", "left_semi")
        return (rows.groupBy("key", "source", "lang", "version")
                .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents > 0"))

    def compact(self) -> bool:
        """Replaces the ledgers of all committed batches by their sums; False
        if nothing was committed since the last time.  What a compaction
        covers is written last, so one that broke off is not seen.  Replaced
        ledgers stay in the folder."""
        names = self.committed()
        if len(names) == len(self._compacted()[1]):
            return False
        self._write(self.current(), "compacted", f"compaction={len(names)}")
        (self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/covered/compaction={len(names)}"))
        return True

    def totals(self) -> DataFrame:
        """documents and tokens by source, lang and tokenizer_version."""
        return (self._read("totals", _TOTALS, self.committed()).groupBy("source", "lang", F.col("version").alias("tokenizer_version"))
                .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents > 0"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch of changes; False if it is committed already."""
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits, - and _")
        if self.has(batch):
            return False
        if not self._names("layout", "buckets", ""):
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/layout/buckets={self.buckets}")
        order = F.array_position(F.array(F.lit("delete"), F.lit("revise"), F.lit("insert")), F.col("kind"))
        self._write(changes.groupBy("key").agg(F.max(F.struct(order.alias("order"), "kind", "tokens", "source", "lang", "version")).alias("c"))
                    .select("key", "c.kind", "c.tokens", "c.source", "c.lang", "c.version"), "changes", f"batch={batch}")
        last = self._read("changes", _CHANGES, [batch]).drop("bucket")
        touched = [int(n) for n in self._names(f"changes/batch={batch}", "bucket", "")]
        old = self.current(last, touched)
        last = last.withColumnRenamed("key", "_key")
        both = last.join(old.select("key", F.col("source").alias("o_source"), F.col("lang").alias("o_lang"), F.col("version").alias("o_version"),
                                    F.col("documents").alias("o_documents"), F.col("tokens").alias("o_tokens")),
                         F.col("_key") == F.col("key"), "left")
        known = F.col("key").isNotNull()
        minus = F.struct(F.col("o_source").alias("source"), F.col("o_lang").alias("lang"), F.col("o_version").alias("version"),
                         (-F.col("o_documents")).alias("documents"), (-F.col("o_tokens")).alias("tokens"))
        plus = F.struct("source", "lang", "version", F.lit(1).cast("long").alias("documents"), "tokens")
        none = F.array().cast("array<struct<source:string,lang:string,version:string,documents:bigint,tokens:bigint>>")
        adds = (F.col("kind") == "insert") | (F.col("kind") == "revise") & known
        signed = both.withColumn("d", F.explode(F.concat(F.when(known, F.array(minus)).otherwise(none), F.when(adds, F.array(plus)).otherwise(none))))
        self._write(signed.select(F.col("_key").alias("key"), "d.*"), "ledger", f"batch={batch}")
        (self._read("ledger", _LEDGER, [batch]).groupBy("source", "lang", "version")
         .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
         .write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}"))
        store, place = self._place("changes", f"batch={batch}")
        store.delete(place, True)
        return True


def exact_copies(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text null) of the documents whose text one of smaller
    doc_id has."""
    thin = docs.select(F.col("doc_id").cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).filter("doc_id is not null")
    first = thin.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (thin.join(first, "h").filter(F.col("doc_id") != F.col("first"))
            .select("doc_id", F.lit(None).cast("string").alias("text")))


def corpus_rollup(docs: DataFrame, path: str) -> DataFrame:
    """The totals after three batches over all documents: all inserted; exact
    copies deleted; documents in other languages than English counted again by
    the multilingual vocabulary.  The second is committed twice, as after a
    broken-off run."""
    rollup = TokenRollup(docs.sparkSession, path)
    rollup.commit("1-insert", counted(docs, "insert", "byte_bpe_50k"))
    rollup.commit("2-copies", deleted(exact_copies(docs)))
    rollup.commit("2-copies", deleted(exact_copies(docs)))
    other = docs.filter(~F.col("lang").eqNullSafe("en"))
    rollup.commit("3-multilingual", counted(other, "revise", "byte_bpe_multi_50k"))
    return rollup.totals()
