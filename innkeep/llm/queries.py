"""One query per operator, with production parameters over whole tables, and
DuckDB's SQL where SQL can express the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from innkeep.llm.common import table
from innkeep.session import staging_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep


def _mix_sql() -> str:
    from innkeep.llm.mixing import MIX_SQL
    return MIX_SQL


@_query("op1_line_blocks")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innkeep.llm.html_lines import extract
    return extract(table(spark, sf_dir, "pages"))


@_query("op2_bottom_k")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innkeep.llm.bottom_k import near_edits
    return near_edits(table(spark, sf_dir, "documents"))


@_query("op3_simhash_pivots")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innkeep.llm.simhash_pivots import simhash_groups
    return simhash_groups(table(spark, sf_dir, "documents"))


@_query("op4_toxicity_bigru")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innkeep.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op5_language_subwords")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innkeep.llm.langid import language
    return language(table(spark, sf_dir, "documents"))


@_query("op6_mixing", _mix_sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innkeep.llm.mixing import label_quality, mix
    mixed = mix(table(spark, sf_dir, "documents"), label_quality(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_query("op7_histogram_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innkeep.llm.histogram_shards import shard_rows
    return shard_rows(table(spark, sf_dir, "documents"))


@_query("op8_pruned_graph")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innkeep.llm.graph_search import nearest_of_every
    return nearest_of_every(table(spark, sf_dir, "embeddings"))


@_query("op9_token_rollup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innkeep.llm.token_rollup import corpus_rollup
    return corpus_rollup(table(spark, sf_dir, "documents"), staging_path(spark, f"token-rollup-{uuid.uuid4()}"))


@_query("op10_binary_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innkeep.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"))


def _audit_sql() -> str:
    from innkeep.llm.filter_audit import AUDIT_SQL
    return AUDIT_SQL


@_query("op11_filter_audit", _audit_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innkeep.llm.filter_audit import filter_audit
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op12_line_crf")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innkeep.llm.line_crf import document_quality
    return document_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op13_edit_tiles")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from innkeep.llm.edit_tiles import spelling_groups
    return spelling_groups(table(spark, sf_dir, "documents"))
