"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the doc_id), so equal texts stand
side by side, and cut where the running bytes come to equal shares.  The cuts are
found without sorting: each round counts the exact bytes and rows below a set
of candidate keys, in one aggregation over a thin table whose result has one
row per candidate, and then narrows every cut's bracket; a cut is settled when
a candidate lies within the tolerance of its share, or at most one row or key
is left between the bracket's ends.  A text that fills more than a shard is cut inside, by
the hash of its ids.  Rows alike in text and doc_id share one key; where a cut falls
among them, it is a number of rows: they are numbered across partitions (counts
per partition, then places within one), and that many go left.

Besides the shards' cuts, each shard is cut into pieces that fit a task.  The
counts below the cuts give each piece's first slot, so after one exchange by
piece a row's slot is its place in its piece plus that number.  Beyond
``MOST_PIECES`` cuts, each piece is dealt to several parts by its rows' place
between the piece's ends, and counts per part give the parts' first slots.

Law ``bytes``: shards' sizes differ by the tolerance and one row's size at
most.  Defined results: a null text has the bytes of an empty one, and its
checksum; a null doc_id is an id like any other; an empty table gives no rows;
further columns are kept by ``sharded`` whatever their names (its own columns
then get underscores)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innkeep.llm.common import free_name, materialize

SHARDS = 8
PIECE_BYTES = 64 << 20       # bytes of text a piece is meant to have
MOST_PIECES = 16_384         # cuts the driver works on; beyond, pieces have parts
PROBES = 8                   # candidate keys per open cut and round
TOLERANCE = 0.001            # of a piece
_HALF, _END = 1 << 63, 1 << 128


def size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def order_id(doc_id: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"))


def _split(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 128 bits as two arrays of signed 64-bit numbers."""
    return (np.array([(k >> 64) - _HALF for k in keys], np.int64),
            np.array([(k & (2 * _HALF - 1)) - _HALF for k in keys], np.int64))


def keys_upto(high: np.ndarray, low: np.ndarray, cut_high: np.ndarray, cut_low: np.ndarray) -> np.ndarray:
    """For each key how many of the sorted cuts are not above it."""
    first, last = np.searchsorted(cut_high, high, "left"), np.searchsorted(cut_high, high, "right")
    out = first.astype(np.int64)
    tied = np.flatnonzero(first < last)
    for at in np.unique(first[tied]):
        rows = tied[first[tied] == at]
        end = last[rows[0]]
        out[rows] = at + np.searchsorted(cut_low[at:end], low[rows], "right")
    return out


def _piece_of(cuts: list[int]):
    high, low = _split(cuts)

    @F.pandas_udf("long")
    def piece(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(keys_upto(h.to_numpy(), d.to_numpy(), high, low))
    return piece


def _part_of(cuts: list[int], parts: int):
    """The part of its piece that a key is in, by its place between the
    piece's ends: keys are hashes, so parts are about even."""
    edges = [0, *cuts, _END]
    high, low = _split([min(k, _END - 1) for k in edges])

    @F.pandas_udf("long")
    def part(piece: pd.Series, h: pd.Series, d: pd.Series) -> pd.Series:
        at = piece.to_numpy()

        def above(a_high: np.ndarray, a_low: np.ndarray) -> np.ndarray:
            """Distance from the piece's lower end; differences are taken
            before they become floating point numbers."""
            wide = (a_high.astype(np.uint64) - high[at].astype(np.uint64)).astype(np.float64)
            return wide * 2.0**64 + (a_low.astype(np.float64) - low[at].astype(np.float64))
        share = above(h.to_numpy(), d.to_numpy()) / np.maximum(above(high[at + 1], low[at + 1]), 1.0)
        return pd.Series(np.clip(share * parts, 0, parts - 1).astype(np.int64))
    return part


@dataclass
class Cuts:
    shards: int
    keys: list[int]          # piece i holds the keys from keys[i - 1] up to keys[i]
    rows_below: list[int]    # rows below keys[i]
    rounds: int
    parts: int               # of every piece
    inside: dict[int, tuple[int, list[int]]]     # key -> (rows of it, how many of them go left of each cut among them)

    @property
    def per_shard(self) -> int:
        return (len(self.keys) + 1) // self.shards


def find_cuts(thin: DataFrame, shards: int = SHARDS, piece_bytes: int = PIECE_BYTES, tolerance: float = TOLERANCE) -> Cuts:
    """Cuts of equal bytes over ``thin`` (h, d, size)."""
    total, rows = thin.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    wanted = max(1, min(-(-total // (shards * piece_bytes)), rows // shards))
    per = max(1, min(wanted, MOST_PIECES // shards))
    pieces = shards * per
    goals = [total * j / pieces for j in range(1, pieces)]
    slack = max(1.0, tolerance * total / pieces)
    low, high = [(0, 0, 0)] * len(goals), [(_END, total, rows)] * len(goals)      # (key, bytes below, rows below)
    rounds = 0
    while True:
        probes: set[int] = set()
        for (a, a_bytes, a_rows), (b, b_bytes, b_rows), goal in zip(low, high, goals):
            if b - a > 1 and b_rows - a_rows > 1 and min(goal - a_bytes, b_bytes - goal) > slack:
                even = {a + (b - a) * i // (PROBES + 1) for i in range(1, PROBES + 1)}
                guess = a + int((b - a) * (goal - a_bytes) / max(1, b_bytes - a_bytes))
                probes |= {k for k in (*even, guess, guess + 1) if a < k < b}
        if not probes:
            break
        rounds += 1
        tried = sorted(probes)
        counted = thin.groupBy(_piece_of(tried)("h", "d").alias("at")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        bytes_at, rows_at = np.zeros(len(tried) + 1, np.int64), np.zeros(len(tried) + 1, np.int64)
        for r in counted:
            bytes_at[r["at"]], rows_at[r["at"]] = r["b"], r["n"]
        below = list(zip(tried, np.cumsum(bytes_at)[:-1].tolist(), np.cumsum(rows_at)[:-1].tolist()))
        weights = [x[1] for x in below]
        for i, goal in enumerate(goals):
            at = int(np.searchsorted(weights, goal, "right"))                     # below[at - 1] <= goal < below[at]
            if at and below[at - 1][0] > low[i][0]:
                low[i] = below[at - 1]
            if at < len(below) and below[at][0] < high[i][0]:
                high[i] = below[at]
    best, inside = [], {}
    for a, b, goal in zip(low, high, goals):
        alike = b[2] - a[2]
        if b[0] - a[0] == 1 and alike > 1:                   # the cut is among the rows of key a, which have one size
            left = max(0, min(alike, round((goal - a[1]) * alike / (b[1] - a[1]))))
            best.append((b[0], a[1], a[2] + left))
            inside.setdefault(a[0], (alike, []))[1].append(left)
        else:
            best.append(a if goal - a[1] <= b[1] - goal else b)
    best.sort(key=lambda c: (c[0], c[2]))
    return Cuts(shards, [min(k, _END - 1) for k, _, _ in best], [n for _, _, n in best], rounds, -(-wanted // per), inside)


def _numbered_alike(rows: DataFrame, cuts: Cuts, piece: str, part: str, h: str, d: str, taken: list[str]) -> DataFrame:
    """``rows``, all of keys with cuts among them, with their piece and part.

    Rows of one key are interchangeable, so each gets a number within its key:
    its place among those of its partition, after the counts of earlier
    partitions.  The rows are checkpointed first, as partitions must not change
    between counting and numbering."""
    pid, at, before = (free_name(c, [*rows.columns, *taken]) for c in ("_pid", "_at", "_before"))
    rows = materialize(rows.withColumn(pid, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    counts = rows.groupBy(pid, h, d).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(h, d).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(pid, h, d).orderBy(at)) - 1      # one partition's rows
    number = F.col(before) + F.col(at)
    rows = rows.withColumn(at, place).join(F.broadcast(counts), [pid, h, d])        # a row per partition and such key
    out_piece, out_part = F.col(piece), F.lit(0).cast("long")
    for key, (alike, left) in cuts.inside.items():
        (high,), (low,) = _split([key])
        mine = (F.col(h) == int(high)) & (F.col(d) == int(low))
        edges = [0, *sorted(left), alike]
        passed = sum(((number >= m).cast("long") for m in edges[1:-1]), F.lit(0).cast("long"))
        out_piece = F.when(mine, F.col(piece) + passed).otherwise(out_piece)
        ends = F.array(*map(F.lit, edges))
        i = passed.cast("int")
        share = (number - ends[i]) / F.greatest(ends[i + 1] - ends[i], F.lit(1))
        # in the piece left of its first cut the key comes last, in the one right of its last cut first
        after = F.when(i == 0, F.lit(2 * cuts.parts)).otherwise(F.lit(0))
        out_part = F.when(mine, after + F.least(F.floor(share * cuts.parts), F.lit(cuts.parts - 1))).otherwise(out_part)
    out_part = out_part if cuts.parts > 1 else F.lit(0).cast("long")
    return rows.withColumn(part, out_part).withColumn(piece, out_piece).drop(pid, at, before)


def sharded(docs: DataFrame, shards: int = SHARDS, piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with a shard and a slot in it, and these columns' names."""
    thin = materialize(docs.select(text_hash(F.col("text")).alias("h"), order_id(F.col("doc_id")).alias("d"), size_of(F.col("text")).alias("size")))
    cuts = find_cuts(thin, shards, piece_bytes)
    shard, slot, piece, part, h, d, n = (free_name(c, docs.columns) for c in ("shard", "slot", "_piece", "_part", "_h", "_d", "_n"))
    first = [0, *cuts.rows_below]
    slot_before = F.array(*(F.lit(k - first[i - i % cuts.per_shard]).cast("long") for i, k in enumerate(first)))
    rows = docs.withColumn(h, text_hash(F.col("text"))).withColumn(d, order_id(F.col("doc_id")))
    rows = rows.withColumn(piece, _piece_of(cuts.keys)(h, d)) if cuts.keys else rows.withColumn(piece, F.lit(0).cast("long"))
    some = F.lit(False)
    if cuts.inside:
        high, low = _split(sorted(cuts.inside))
        for a, b in zip(high.tolist(), low.tolist()):
            some |= (F.col(h) == a) & (F.col(d) == b)
    plain = rows.filter(~some) if cuts.inside else rows
    plain = plain.withColumn(part, _part_of(cuts.keys, cuts.parts)(piece, h, d) + cuts.parts if cuts.parts > 1 else F.lit(0).cast("long"))
    if cuts.inside:
        plain = plain.unionByName(_numbered_alike(rows.filter(some), cuts, piece, part, h, d, [part]))
    place = F.row_number().over(Window.partitionBy(piece, part).orderBy(h, d)) - 1
    if cuts.parts > 1:
        counts = plain.groupBy(piece, part).agg(F.count(F.lit(1)).alias(n))
        earlier = Window.partitionBy(piece).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        counts = materialize(counts.withColumn(n, F.coalesce(F.sum(n).over(earlier), F.lit(0))))
        plain, place = plain.withColumn(slot, place).join(counts, [piece, part]), F.col(slot) + F.col(n)
    out = (plain.withColumn(slot, (place + F.element_at(slot_before, (F.col(piece) + 1).cast("int"))).cast("long"))
           .withColumn(shard, F.floor(F.col(piece) / cuts.per_shard).cast("int")))
    return out.select(*[F.col(c) for c in docs.columns], slot, shard), (shard, slot)


def shard_rows(docs: DataFrame, shards: int = SHARDS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The placement alone: doc_id, size, text_crc32, law, shard, slot,
    grown_shard (none under this law)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("size", size_of(F.col("text"))).withColumn("text_crc32", text_crc32(F.col("text")))
    out, (shard, slot) = sharded(rows, shards, piece_bytes)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col(shard).alias("shard"),
                      F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
