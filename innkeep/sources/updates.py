"""Keyed UPDATE of stored tables, rewriting the touched partitions only.

A table is kept as Parquet partitioned by a hash bucket of its storage key
(``layout.by_bucket``).  An update reads the buckets its keys hash to, applies
the new values, stages the complete new partitions in the shared folder, and
then replaces exactly these partitions (dynamic partition overwrite); all other
files stay as they are.  The staged rows do not depend on the table any more,
so an overwrite that broke off half-way is repeated by writing them again.

One writer at a time: Parquet folders have no transactions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.session import materialize
from innkeep.sources.layout import BUCKET, bucket_of, by_bucket


class StoredTable:
    """A table under ``path``, partitioned by the bucket of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, uid: str, buckets: int) -> "StoredTable":
        """Write ``df`` to a new ``path``; ``updated_at`` starts as NULL."""
        stamped = df.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
        by_bucket(stamped, key, uid, buckets).write.mode("error").partitionBy(BUCKET).parquet(path)
        return cls(df.sparkSession, path, key, buckets)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def append(self, rows: DataFrame) -> None:
        """INSERT: new files in the buckets of the rows."""
        rows = rows.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
        by_bucket(rows, self.key, self.key, self.buckets).write.mode("append").partitionBy(BUCKET).parquet(self.path)

    def touched(self, changes: DataFrame) -> DataFrame:
        """The stored rows of the buckets that ``changes`` hash to, pruned by
        these buckets (at most ``buckets`` numbers are broadcast)."""
        wanted = changes.select(bucket_of(self.key, self.buckets).alias(BUCKET)).distinct().where(F.col(BUCKET) >= 0)
        return self._stored().join(F.broadcast(wanted), BUCKET, "left_semi")

    def update(self, changes: DataFrame, on: Sequence[str], values: Mapping[str, Column], as_of: str) -> None:
        """``UPDATE .. SET values, updated_at = as_of`` for the rows whose
        ``on`` columns (the storage key among them) are in ``changes``, whose
        keys are unique.  ``values``: stored column -> expression over the
        columns of ``changes``."""
        if self.key not in on:
            raise ValueError(f"an update names the storage key {self.key}")
        new = materialize(changes.select(*on, F.struct(*[v.alias(c) for c, v in values.items()]).alias("_new")))
        rows = self.touched(new).join(new, list(on), "left")
        hit = F.col("_new").isNotNull()
        stamp = F.to_timestamp_ntz(F.lit(as_of))

        def value(c: str) -> Column:
            if c == "updated_at":
                return F.when(hit, stamp).otherwise(F.col(c)).alias(c)
            return F.when(hit, F.col(f"_new.{c}").cast(self._stored().schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c)

        staged = materialize(rows.select(*[value(c) for c in self._stored().columns]))
        (staged.repartitionByRange(BUCKET, *on).sortWithinPartitions(BUCKET, *on)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path))
