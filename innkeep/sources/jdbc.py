"""The service's own MySQL tables as a Spark source (not exercised here:
no database is reachable from the build environment).

A table is read in ``num_partitions`` parallel range scans on its surrogate
``id`` (``INT PRIMARY KEY AUTO_INCREMENT``), the bounds coming from one
``MIN/MAX`` query the database answers from its primary-key index.  Column
lists and simple filters given to the DataFrame are pushed into the SQL each
partition sends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_mysql_table(spark: SparkSession, url: str, table: str, properties: dict,
                     num_partitions: int = 64, partition_column: str = "id",
                     fetch_size: int = 10_000) -> DataFrame:
    bounds = (spark.read.format("jdbc")
              .option("url", url)
              .option("query", f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {table}")
              .options(**properties)
              .load()
              .first())
    lo, hi = (bounds["lo"], bounds["hi"]) if bounds and bounds["lo"] is not None else (0, 0)
    return (spark.read.format("jdbc")
            .option("url", url)
            .option("dbtable", table)
            .option("partitionColumn", partition_column)
            .option("lowerBound", str(lo))
            .option("upperBound", str(hi + 1))
            .option("numPartitions", str(num_partitions))
            .option("fetchsize", str(fetch_size))
            .options(**properties)
            .load())
