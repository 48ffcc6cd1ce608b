"""Toxicity scores of whole texts.

The model (``bigru``) is trained on the driver on a bounded sample of labelled
rows, then scores all overlapping windows of every text in the tasks; a text's
score is that of its highest window.

Defined results: a null or empty text, or one without any letter, has score
0; repeated rows have equal scores; a null doc_id counts as not held out;
with no labelled rows of one of the two classes to learn from every score is 0
(no label 1) or 1 (no label 0); an empty table gives no rows; further columns
are kept by ``scored`` whatever their names (the new one then gets
underscores)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innkeep.llm import bigru
from innkeep.llm.common import append_columns, arrow_schema_with, free_name, held_out, row_slices, text_buffer

THRESHOLD = 0.3
TRAIN_ROWS = 1000        # labelled rows of each class at most
TRAIN_TEXT = 8000        # bytes; longer texts are left out of the sample where a class has shorter ones, and scored whole
SPARE = 1.3
_HASHES = 1 << 20
_SLICE = 400_000         # bytes of text worked on at once


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_TEXT) -> list[tuple[str, int]]:
    """(text, label) of up to ``rows`` texts of each class that are not held
    out.  About ``SPARE`` times as many ids are drawn, by their hashes, from
    those with texts of up to ``text_bytes``; a class without any has whole
    longer texts, as many as have the bytes of that many shorter ones, and one
    at least."""
    size = F.octet_length("text")
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_label"))
             .withColumn("_spot", F.pmod(F.xxhash64("_id"), F.lit(_HASHES))))
    texts = (docs.filter(F.col("doc_id").isNotNull() & (size >= 1))
             .select(F.col("doc_id").cast("long"), (size > text_bytes).alias("_long"), "text"))
    pairs = texts.groupBy("doc_id", "_long").agg(F.max(size).alias("_bytes")).join(known, F.col("doc_id") == F.col("_id"))
    many = (pairs.groupBy("_label", "_long").agg(F.count(F.lit(1)).alias("n"), F.min("_spot").alias("first"), F.avg("_bytes").alias("bytes"))
            .collect())                                                      # at most four rows
    used = {r["_label"]: r for r in sorted(many, key=lambda r: r["_long"], reverse=True)}     # shorter ones where there are any
    draw = F.lit(False)
    for label, r in used.items():
        share = max(1, min(rows, int(rows * text_bytes / r["bytes"]))) if r["_long"] else rows
        below = max(int(-(-_HASHES * SPARE * share // r["n"])), r["first"] + 1)
        draw |= (F.col("_label") == label) & (F.col("_long") == r["_long"]) & (F.col("_spot") < below)
    drawn = pairs.filter(draw).select("_id", F.col("_long").alias("_of"), "_label", "_spot")
    found = (texts.join(F.broadcast(drawn), (F.col("doc_id") == F.col("_id")) & (F.col("_long") == F.col("_of")))    # about 2 * SPARE * rows ids
             .select("_spot", "doc_id", "text", "_label").collect())
    found.sort(key=lambda r: (r["_spot"], r["doc_id"], r["text"]))
    taken: dict[int, list[str]] = {0: [], 1: []}
    spent = {0: 0, 1: 0}
    for r in found:
        label, more = r["_label"], len(r["text"].encode())
        if not taken[label] or len(taken[label]) < rows and spent[label] + more <= rows * text_bytes:
            taken[label].append(r["text"])
            spent[label] += more
    return [(text, label) for label in (0, 1) for text in taken[label]]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> bigru.BiGRU | float:
    """The trained network, or a constant score where one class is missing."""
    sample = training_sample(docs, labels, rows)
    label = np.array([y for _, y in sample])
    if not len(label) or not label.any():
        return 0.0
    if label.all():
        return 1.0
    data, offsets = text_buffer(pa.array([t for t, _ in sample], pa.large_string()))
    return bigru.train(data, offsets, label)


def text_scores(model: bigru.BiGRU | float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if not isinstance(model, bigru.BiGRU):
        return np.full(len(offsets) - 1, float(model))
    logit = model.text_logits(data, offsets).astype(np.float64)
    return 1 / (1 + np.exp(-np.clip(logit, -700, 700))) * np.isfinite(logit)


def scored(docs: DataFrame, model: bigru.BiGRU | float, name: str = "score") -> tuple[DataFrame, str]:
    """``docs`` with a column of scores, and that column's name."""
    name = free_name(name, docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, of fixed size
    spot = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(spot))
            for lo, hi in row_slices(offsets, _SLICE):
                got = text_scores(shared.value, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                yield append_columns(batch.slice(lo, hi - lo), {name: pa.array(got, pa.float64())})

    return docs.mapInArrow(run, arrow_schema_with(docs, **{name: T.DoubleType()})), name


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out, score = scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"),
                      (F.col(score) >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold."""
    out, score = scored(docs, fit(docs, labels))
    return out.filter(F.col(score) < threshold).drop(score)
