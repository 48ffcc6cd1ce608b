"""Packing by power-of-two decomposition.

Each document's ids (with a closing id) are cut into pieces whose lengths are
the binary decomposition of their number: as many pieces of the longest
length as fit, then one piece for each set bit of the rest, longest first.
Every piece is a sequence of its own, so no sequence crosses documents, none
is padded, and sequences of one length can be batched together: sequence ids
run through the buckets from the longest length to the shortest.

Defined results: a null text is empty and has the closing id only (one piece
of length 1); repeated rows are packed once each; an empty table gives no
rows; further columns of the input, whatever their names, are not carried."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innkeep.llm.common import materialize
from innkeep.llm.tokenizing import DEFAULT_JSON, token_array

MAX_LENGTH = 2048
CLOSING_ID = 1

_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "bucket int, part int, place long")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("part", pa.int32()), ("place", pa.int64())])


def binary_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """The piece lengths of ``n`` ids, longest first; ``max_length`` is a
    power of two."""
    full, rest = divmod(n, max_length)
    return [max_length] * full + [1 << k for k in range(max_length.bit_length() - 2, -1, -1) if rest >> k & 1]


def pieces(docs: DataFrame, tokenizer: str = DEFAULT_JSON, max_length: int = MAX_LENGTH,
           closing_id: int = CLOSING_ID) -> DataFrame:
    """One row per piece, with its place among its input partition's pieces of
    the same length (``bucket`` is the binary logarithm of the length)."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * max_length.bit_length()
        for batch in batches:
            out: list[tuple] = []
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            for doc_id, text in zip(ids_of, texts):
                ids = token_array(text.as_py() or "", closing_id, tokenizer)
                raw, start = memoryview(ids).cast("B"), 0
                for length in binary_lengths(len(ids), max_length):
                    k = length.bit_length() - 1
                    out.append((doc_id, start, length, zlib.crc32(raw[4 * start:4 * (start + length)]), len(ids), k, part, seen[k]))
                    seen[k] += 1
                    start += length
                if len(out) >= 50_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer: str = DEFAULT_JSON, max_length: int = MAX_LENGTH,
         closing_id: int = CLOSING_ID) -> DataFrame:
    """Pieces with their sequences: ``sequence_id`` is gapless from 0 over the
    buckets, longest length first; ``offset`` is 0, for each piece fills its
    sequence.

    The ids are made once (the pieces are checkpointed: a few numbers a
    piece).  A sequence id is the count of longer pieces, plus that of equal
    ones in earlier partitions, plus the place within the partition; only
    counts per (length, partition) are added up, no row is sorted."""
    done = materialize(pieces(docs, tokenizer, max_length, closing_id))
    counts = done.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("_n"))
    totals = {r["bucket"]: r["n"] for r in counts.groupBy("bucket").agg(F.sum("_n").alias("n")).collect()}
    base, before = {}, 0                                     # a dozen lengths at most
    for k in sorted(totals, reverse=True):
        base[k], before = before, before + totals[k]
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.create_map(*(F.lit(x) for k in base for x in (k, base[k]))) if base else F.create_map(F.lit(0), F.lit(0))
    offsets = counts.select("bucket", "part", (first[F.col("bucket")] + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_first"))
    return (done.join(offsets, ["bucket", "part"])
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                    (F.col("_first") + F.col("place")).cast("long").alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset"), F.col("bucket").alias("length_log2")))


def unpack(packed: DataFrame) -> DataFrame:
    """Back to documents: per document and packing the piece lengths in order;
    what a reader needs to join the pieces again."""
    return packed.groupBy("doc_id").agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
