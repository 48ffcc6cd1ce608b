"""Documents to packed training sequences, in five stages.

1. toxicity: documents whose score reaches the threshold go;
2. language: documents whose language is not recognised go;
3. near_duplicates: one document of each SimHash group stays;
4. mixing: documents repeat, or go, as the mix of their sources takes them;
5. packing: the pieces and sequences of what is left.

Each stage gets what the one before kept and returns the columns of its input
(the last: pieces).  ``run`` writes every stage's rows as Parquet in the
shared folder and reads them again, so a lost executor repeats one stage's
tasks at most; a stage's input is removed once its result is written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from innkeep.llm.common import remove, table
from innkeep.llm.langid import recognised_only
from innkeep.llm.mixing import label_quality, mixed_documents
from innkeep.llm.packing import pack
from innkeep.llm.simhash_pivots import keep_one_per_group
from innkeep.llm.toxicity import without_toxic
from innkeep.session import staging_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recognised_only(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, label_quality(table(spark, sf_dir, "labels")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates),
          ("mixing", mixing), ("packing", packing)]

#: Trained models and token ids cannot be had in SQL; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, place = table(spark, sf_dir, "documents"), f"pipeline-{uuid.uuid4()}"
    path = None
    for name, stage in STAGES:
        written, path = path, staging_path(spark, f"{place}/{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if written:
            remove(spark, written)
    return docs
