"""Bottom-k sketches of texts' shingle hashes.

A sketch is the ``k`` smallest different hashes of a text's five-word
shingles (repeats count once; a text of fewer words has one shingle of them
all).  Sketches of parts merge into the sketch of the whole: the ``k`` smallest
of both.  From two sketches, the share of common hashes among the ``k`` smallest
of their union estimates resemblance (Jaccard similarity); the k-th smallest
hash estimates a text's number of different shingles, and both together
containment.  With fewer than ``k`` hashes all three are exact.

Defined results: a null text is empty, and an empty sketch resembles an empty
one fully and others not at all; a null doc_id comes first in the order of
documents and rows of equal doc_id are ordered by their text's hash, so each
row has a next one; a single row is its own next; an empty table gives no rows;
further columns, whatever their names, are not carried."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import materialize, partitions_for, text_buffer
from innkeep.llm.textscan import RangeHasher, shingles, words

K = 128
SHINGLE = 5
HASH_BITS = 48
PART_BYTES = 16 << 20        # bytes of text a range of documents is meant to have
_GROUP_BYTES = 400_000       # bytes worked on at once


# --- sketches ---------------------------------------------------------------

def sketches(data: np.ndarray, offsets: np.ndarray, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text, as sorted numbers of ``HASH_BITS`` bits."""
    start, end, first = words(data, offsets)
    hashes, at = shingles(RangeHasher(data)(start, end), first, shingle)
    hashes >>= np.uint64(64 - HASH_BITS)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        h = hashes[a:b]
        if len(h) > 8 * k:                                   # most texts repeat little: look at the smallest first
            part = np.unique(np.partition(h, 2 * k)[:2 * k])
            if len(part) >= k:
                out.append(part[:k])
                continue
        out.append(np.unique(h)[:k])
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts' shingles together."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    # the k smallest of the union: without the second of each pair, up to rank k
    rank = np.arange(1, len(both)) - np.cumsum(twice) + 1    # rank in the union of both[1:]
    size = min(k, len(both) - int(twice.sum()))
    return float((twice & (rank <= size)).sum() / size)


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of different shingles."""
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) / ((float(sketch[k - 1]) + 1) / 2.0 ** HASH_BITS)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    if not len(a):
        return 1.0
    r, n = resemblance(a, b, k), distinct(a, k)
    return min(1.0, r * (n + distinct(b, k)) / (1 + r) / n)


def encode(sketch: np.ndarray) -> str:
    """As text: six bytes, big-endian, for each hash, in base 64."""
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BITS // 8:]
    return base64.b64encode(raw.tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, HASH_BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - HASH_BITS // 8:] = raw
    return wide.view(">u8").reshape(-1).astype(np.uint64)


def sketch_texts(texts: list[str], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    return sketches(*text_buffer(pa.array(texts, pa.large_string())), k, shingle)


def fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint, shingles (estimated number) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                found = sketches(*text_buffer(part.column(1)), k, shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(s) for s in found], pa.string()),
                                                  pa.array([distinct(s, k) for s in found], pa.float64())],
                                                 names=["doc_id", "fingerprint", "shingles"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, fingerprint string, shingles double"))


# --- each document with the next --------------------------------------------

def with_next_in_ranges(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (range, extra, doc_id, text) such that sorting a range by (extra,
    order, tie) puts every document before the next one by doc_id.

    Documents are cut into ranges of doc_id; each range's first document is
    sent to the range before as an extra row, and the first of all to the last
    range.  So one exchange carries each text once, and no row waits for
    another task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("order", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = partitions_for(size, part_bytes)
    bounds = np.zeros(0, np.int64)
    if parts > 1:                                            # bounds need not be exact, only fixed
        shares = [i / parts for i in range(1, parts)]
        got = rows.agg(F.percentile_approx("order", shares, max(10_000, 20 * parts)).alias("b")).first()["b"]
        bounds = np.unique(np.array(got, np.int64))

    @F.pandas_udf("int")
    def range_of(order: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, order.to_numpy(), "right").astype(np.int32))

    firsts = materialize(rows.select("order").withColumn("range", range_of("order")).groupBy("range").agg(F.min("order").alias("order")))
    found = sorted((r["range"], r["order"]) for r in firsts.collect())             # one row a range
    if not found:
        return rows.select(F.lit(0).alias("range"), F.lit(False).alias("extra"), "order", F.lit(0).cast("long").alias("tie"), "doc_id", "text")
    previous = {order: found[i - 1][0] for i, (_, order) in enumerate(found)}
    orders, before = np.array(sorted(previous), np.int64), np.array([previous[o] for o in sorted(previous)], np.int32)

    @F.pandas_udf("int")
    def sent_to(order: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(orders, order.to_numpy()), len(orders) - 1)
        return pd.Series(np.where(orders[at] == order.to_numpy(), before[at], -1).astype(np.int32))

    rows = rows.withColumn("range", range_of("order")).withColumn("_sent", sent_to("order"))
    home = F.struct(F.col("range"), F.lit(False).alias("extra"))
    extra = F.struct(F.col("_sent").alias("range"), F.lit(True).alias("extra"))
    return (rows.withColumn("_at", F.explode(F.when(F.col("_sent") < 0, F.array(home)).otherwise(F.array(home, extra))))
            .select("_at.range", "_at.extra", "order", F.xxhash64("text").alias("tie"), "doc_id", "text"))


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the
    next text, or all of them."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def near_edits(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Every document's fingerprint and that of its edited text, and the
    resemblance to the edited text and to the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_shingles (estimated), edited_contains (share of
    the text's shingles found in the edited text)."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles", "edited_contains"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]

    def rows_out(held: list[tuple[int, bool, int | None, str]]) -> pa.RecordBatch:
        """``held``: successive rows; a result for each but the last, unless it
        is an extra row or its range ends with it."""
        plain = sketch_texts([t for _, _, _, t in held], k, shingle)
        edited = [edited_text(t, held[i + 1][3]) if i + 1 < len(held) else "" for i, (_, _, _, t) in enumerate(held)]
        changed = sketch_texts(edited, k, shingle)
        out = []
        for i in range(len(held) - 1):
            part, extra, doc_id, text = held[i]
            if extra or held[i + 1][0] != part:
                continue
            a, b = plain[i], changed[i]
            out.append((doc_id, len(text), hashlib.sha256(edited[i].encode()).hexdigest(), encode(a), encode(b),
                        resemblance(a, b, k), resemblance(a, plain[i + 1], k), distinct(a, k), containment(a, b, k)))
        columns = list(zip(*out)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int | None, str]] = []
        size = 0
        for batch in batches:
            for part, extra, doc_id, text in zip(*(c for c in batch.columns)):
                held.append((part.as_py(), extra.as_py(), doc_id.as_py(), text.as_py() or ""))
                size += len(held[-1][3])
                if size >= _GROUP_BYTES and len(held) > 1:
                    yield rows_out(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield rows_out(held)

    placed = with_next_in_ranges(docs)
    return (placed.repartition("range").sortWithinPartitions("range", "extra", "order", "tie").select("range", "extra", "doc_id", "text")
            .mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                             "near_edited double, near_next double, n_shingles double, edited_contains double"))
