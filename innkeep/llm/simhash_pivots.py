"""SimHash near-duplicates by pivot distance tables.

A fingerprint has a bit set where over half of a text's 3-word shingle hashes
(XXH64 of the UTF-8 bytes, seed 42) have it set.  Equal fingerprints are
collapsed first, so copies cost nothing further.  Each distinct fingerprint
gets a table row of Hamming distances to fixed reference fingerprints
(pivots).  By the triangle inequality two fingerprints within ``max_bits`` of
each other differ by at most ``max_bits`` in every column; the join sorts a
group by one column, compares only rows within ``max_bits`` there, drops pairs
by the largest difference over the other columns, and verifies the survivors
with the exact bit distance.

In 64 dimensions distances to any pivot concentrate around 32, so the table
alone would leave a constant share of all pairs.  Rows therefore meet in
groups that no linked pair can miss: the bits are cut into ``max_bits + 2``
blocks, and a pair within ``max_bits`` agrees on two whole blocks at least;
one group per choice of two blocks (ten for three bits).

A group above ``CELL`` rows is cut into chunks, and each pair of chunks is a
cell of its own, so no task holds a group.  Cells emit no pairs, only one
edge per row to the smallest member of its local component.

Defined results: a null text is empty; a text without words has fingerprint
zero, linked like any other; a null doc_id never is a component's smallest;
repeated rows keep one result row each; an empty table gives no rows; further
columns of the input, whatever their names, are not carried."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innkeep.llm.common import free_name, materialize, row_slices, text_buffer
from innkeep.llm.components import min_label_components
from innkeep.llm.textscan import LOWER, SPACE, mix64, words

SHINGLE = 3
MAX_BITS = 3
SEED = 42
CELL = 1024            # rows a group may have before it is cut into chunks
PIVOTS = 16
_PAIRS_AT_ONCE = 1 << 20


def pivot_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: mixed counters, so half their bits differ
    pairwise."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def blocks(n: int) -> list[int]:
    """64 bits cut into ``n`` masks of almost equal width."""
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def group_masks(max_bits: int = MAX_BITS) -> list[int]:
    """Masks of every two of ``max_bits + 2`` blocks."""
    return [a | b for a, b in itertools.combinations(blocks(max_bits + 2), 2)]


# --- fingerprints -----------------------------------------------------------

_BYTE_ONES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the word whose bits are set in over half of its hashes;
    zero for a text without any.

    The eight bits k, k+8, ... are counted in the eight bytes of one word, in
    runs of at most 255 hashes so that no byte overflows."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    has = np.flatnonzero(n)
    if not len(has):
        return out
    runs = -(-n[has] // 255)
    run_first = np.concatenate([[0], np.cumsum(runs)])
    starts = np.repeat(first[:-1][has], runs) + 255 * (np.arange(run_first[-1]) - np.repeat(run_first[:-1], runs))
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _BYTE_ONES, starts)
        per = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), run_first[:-1], axis=0)
        over = (2 * per > n[has][:, None]).astype(np.uint64)
        for j in range(8):
            out[has] |= over[:, j] << np.uint64(8 * j + k)
    return out


def simhashes(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of UTF-8 texts laid end to end."""
    low = LOWER[data]
    start, end, first = words(low, offsets)
    counts = np.diff(first)
    if len(start) == 0:
        return np.zeros(len(counts), np.uint64)
    # words of a text with exactly one space between: keep word bytes and the byte after each word
    keep = ~SPACE[low]
    low[~keep] = 0x20
    last = np.zeros(len(start), bool)
    last[first[1:][counts > 0] - 1] = True
    keep[end[~last]] = True
    place = np.cumsum(keep) - 1
    raw = low[keep].tobytes()
    n_out = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(n_out)])
    pos = np.arange(out_first[-1]) - np.repeat(out_first[:-1], n_out) + np.repeat(first[:-1], n_out)
    width = np.repeat(np.minimum(counts, shingle), n_out)
    begin, stop = place[start[pos]].tolist(), (place[end[pos + width - 1] - 1] + 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begin, stop)), np.uint64, len(begin))
    return majority_bits(hashes, out_first)


def with_fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``rows``, whose last column is a text, with the fingerprint ``fp`` (as a
    signed long) in its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.num_columns - 1))
            for lo, hi in row_slices(offsets, 400_000):
                fp = simhashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], shingle)
                kept = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(fp.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row."""
    return with_fingerprints(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), shingle)


def fp_hex(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- the pivot join ---------------------------------------------------------

def cell_edges(cell: np.ndarray, fp: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the links within cells.  ``cell`` numbers the rows' cells and
    is sorted.  Returned are (row's fingerprint, smallest fingerprint of its
    local component) where the two differ."""
    table = np.bitwise_count(fp[:, None] ^ pivot_fingerprints()[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], cell))
    cell, fp, table = cell[order], fp[order], table[order]
    # rows in one cell lie apart by 128 or more from the next cell on this axis
    axis = cell.astype(np.int64) * 128 + table[:, 0]
    reach = np.searchsorted(axis, axis + max_bits, "right") - np.arange(len(fp)) - 1
    links_a, links_b = [], []
    total = np.concatenate([[0], np.cumsum(reach)])
    lo = 0
    while lo < len(fp):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _PAIRS_AT_ONCE, "right")) - 1)
        n = reach[lo:hi]
        a = np.repeat(np.arange(lo, hi), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], n)
        for p in range(1, table.shape[1]):                  # largest coordinate difference, column by column
            near = np.abs(table[a, p] - table[b, p]) <= max_bits
            a, b = a[near], b[near]
            if len(a) < 64:
                break
        sure = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        links_a.append(a[sure])
        links_b.append(b[sure])
        lo = hi
    a, b = np.concatenate(links_a or [np.zeros(0, int)]), np.concatenate(links_b or [np.zeros(0, int)])
    rank = np.empty(len(fp), np.int64)                      # labels follow the signed order that Spark sees
    rank[np.lexsort((fp.view(np.int64), cell))] = np.arange(len(fp))
    root, a, b = np.arange(len(fp)), rank[a], rank[b]       # a forest over ranks; larger roots hang on smaller ones
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    label = root[rank]
    of_rank = np.empty(len(fp), np.uint64)
    of_rank[rank] = fp
    to = of_rank[label]
    moved = to != fp
    return fp[moved], to[moved]


def _edges_of_sorted(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Cells arrive whole and in order; the last cell of a batch may go on in
    the next, so it is held back."""
    held: list[np.ndarray] = []
    for batch in itertools.chain(batches, [None]):
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch is not None and batch.num_rows else None
        if batch is not None and rows is None:
            continue
        if batch is not None:
            held.append(rows)
            joined = np.concatenate(held) if len(held) > 1 else rows
            new = np.flatnonzero((joined[1:, :-1] != joined[:-1, :-1]).any(axis=1)) + 1
            if not len(new):
                held = [joined]
                continue
            ready, held = joined[:new[-1]], [joined[new[-1]:]]
        else:
            ready, held = (np.concatenate(held) if held else np.zeros((0, 2), np.int64)), []
        if not len(ready):
            continue
        cell = np.concatenate([[0], np.cumsum((ready[1:, :-1] != ready[:-1, :-1]).any(axis=1))])
        u, v = cell_edges(cell, np.ascontiguousarray(ready[:, -1]).view(np.uint64), max_bits)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])


def pivot_edges(distinct: DataFrame, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that span the same
    components as all pairs within ``max_bits``."""
    masks = [m - (1 << 64) if m >> 63 else m for m in group_masks(max_bits)]
    keyed = distinct.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value"))
        for i, m in enumerate(masks)))).alias("k")).select("fp", "k.mask", "k.value")
    shared = materialize(keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    chunks = F.ceil(F.col("n") / F.lit(cell)).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    # chunk pairs (a, b), a < b, cover all pairs of a group; a group of one chunk is the cell (0, 0)
    cells = (keyed.join(shared, ["mask", "value"]).withColumn("chunks", chunks).withColumn("own", own)
             .withColumn("other", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long")))
                                            .otherwise(F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), F.col("own")))))
             .select("mask", "value", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp"))
    keys = ["mask", "value", "a", "b"]
    return (cells.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(lambda batches: _edges_of_sorted(batches, max_bits), "u long, v long"))


def components(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, label (one fingerprint of the group), component_id (the smallest
    ``first_id`` of it) of ``distinct``, a table of different fingerprints."""
    labels = min_label_components(pivot_edges(distinct, max_bits))
    of_fp = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = of_fp.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return materialize(of_fp.select("fp", "label").join(smallest, "label").select("fp", "label", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links of at
    most ``max_bits`` differing bits) of every row."""
    rows = materialize(fingerprints(docs, shingle))
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    return rows.join(components(distinct, max_bits).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The operator's result: doc_id, fingerprint (16 hexadecimal digits) and
    component_id of every row."""
    return near_duplicates(docs, shingle, max_bits).select("doc_id", fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: one row
    a group, of those with its smallest doc_id (null only where the group has
    no other) the one of smallest text, by hash, and then of smallest hash of
    all columns; of rows alike in everything one stays.

    Rows are told apart by a hash of all their columns, so nothing is matched
    by doc_id and no text is copied.  Texts of any length are taken whole;
    columns of any type and name are kept."""
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    others = F.to_json(F.struct(*[v for c, v in quoted.items() if c != "text"])) if len(quoted) > 1 else F.lit("")
    text = F.col("text").cast("string")
    same = F.coalesce(F.sha2(text, 256), F.lit(""))
    mark = F.md5(F.concat(same, others).cast("binary"))
    thin = materialize(with_fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), same.alias("same"), mark.alias("mark"), text.alias("text")), shingle))
    group_of = components(materialize(thin.groupBy("fp").agg(F.min("doc_id").alias("first_id"))), max_bits)
    # partial aggregates: however many rows a group has, a task passes on one
    best = thin.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same", "mark")).alias("best"))
    kept = (best.join(group_of.select("fp", "label"), "fp").groupBy("label").agg(F.min("best").alias("best")).select(F.col("best.mark").alias("mark")))
    alike = thin.groupBy("mark").agg(F.count(F.lit(1)).alias("rows"))
    own = free_name("_mark", docs.columns)
    kept = materialize(kept.join(alike, "mark").select(F.col("mark").alias(own), "rows"))
    marked = docs.withColumn(own, mark)
    if not kept.filter("rows > 1").head(1):
        return marked.join(kept, own, "left_semi").drop(own)
    once = marked.join(kept.filter("rows = 1"), own, "left_semi").drop(own)
    row = free_name("_row", [*docs.columns, own])
    many = (marked.join(kept.filter("rows > 1"), own, "left_semi").groupBy(own).agg(F.first(F.struct(*quoted.values())).alias(row))
            .select(*[F.col(row)[c].alias(c) for c in docs.columns]))
    return once.unionByName(many)
