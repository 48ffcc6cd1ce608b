"""Base tables: the driver's parquet files, one per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "pages")


class Tables:
    """Lazy reader over one scale-factor directory.  Every access is a fresh
    ``spark.read.parquet`` so Catalyst sees the file scan and can push
    filters / prune columns into it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.read(name)
        raise AttributeError(name)
