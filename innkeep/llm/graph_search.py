"""Approximate nearest neighbours by largest inner product.

Rows are dealt by id to shards; each shard gets a robust-pruned graph of its
own (``pruned_graph``), stored as one row of a checkpointed table.  Shards have
about ``SHARD_ROWS`` rows while that makes no more of them than the session has
cores, and beyond that as many as ``SHARD_BYTES`` of vectors and edges hold: a
search costs hardly more in a large graph than in a small one.  Queries come in
blocks of ``BLOCK_QUERIES``; a block meets a shard's graph in a task of its own,
so a graph is sent once for each block; a beam search finds each query's nearest
there, and the shards' lists are merged.  Scores are inner products of the
original vectors in double precision.

Every query has to search every shard: vectors need not lie in clusters, so no
shard can be left out.  Queries that grow with the rows therefore cost (queries
x shards) searches, of about 2 ms each.

The graphs are built for largest inner product by bringing all vectors to one
length with one more coordinate.  That works well only for vectors of similar
length, so a shard has a graph for each band of lengths (a factor of ``BAND``),
and all are searched; unit vectors have one.

Copies of a vector are one point of a shard's graph with a list of ids, so a
vector that a third of the rows share costs one point, and its copies come in
order of their ids.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without vec_id; rows repeating a vec_id
count once (the one of smallest components, found before rows are dealt); vectors meet only vectors of as
many components; a query without any candidate has no rows; an empty table
gives no rows; further columns, whatever their names, are not carried."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innkeep.llm.common import materialize
from innkeep.llm.pruned_graph import DEGREE, SLACK, Graph, build

SHARD_ROWS, SHARD_BYTES = 8192, 32 << 20
BLOCK_QUERIES = 16_384
TOP, BEAM = 20, 160
BAND, MOST_BANDS = 1.5, 12     # the last band holds all that is shorter
EVERY = 20                   # queries: rows whose vec_id is divisible by this


def usable(df: DataFrame) -> DataFrame:
    """vec_id, embedding (in double precision) of the rows that take part, one
    a vec_id."""
    v = F.col("embedding")
    whole = df.select(F.col("vec_id").cast("long"), v.cast("array<double>")).filter(
        F.col("vec_id").isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0))
    return whole.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _by_width(ids: pd.Series, vectors: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) for each number of components, by id."""
    ids, width = ids.to_numpy(np.int64), vectors.map(len).to_numpy(np.int64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        at = at[np.argsort(ids[at])]
        yield ids[at], np.stack(vectors.iloc[at].to_list())


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def shard_graphs(rows: pd.DataFrame) -> pd.DataFrame:
    """The shard's graphs as bytes: one for each number of components and band
    of lengths."""
    out = []
    for ids, vectors in _by_width(rows["vec_id"], rows["embedding"]):
        length = np.linalg.norm(vectors / np.abs(vectors).max(), axis=1)
        band = np.minimum(np.log(length.max() / np.maximum(length, 1e-300)) / np.log(BAND), MOST_BANDS - 1).astype(int)
        for one in np.unique(band):
            distinct, group = np.unique(vectors[band == one], axis=0, return_inverse=True)
            group, own = group.reshape(-1), ids[band == one]
            order = np.lexsort((own, group))
            graph = build(distinct)
            out.append((int(rows["shard"].iloc[0]), _pack(
                vectors=distinct, points=graph.points, edges=graph.edges, entries=graph.entries, ids=own[order],
                first=np.searchsorted(group[order], np.arange(len(distinct) + 1)))))
    return pd.DataFrame(out, columns=["shard", "graph"])


def _search_block(graphs: pd.DataFrame, queries: pd.DataFrame, top: int, beam: int) -> pd.DataFrame:
    asked = {x.shape[1]: (i, x) for i, x in _by_width(queries["vec_id"], queries["embedding"])}
    out_q, out_v, out_s = [], [], []
    for raw in graphs["graph"]:
        g = np.load(io.BytesIO(raw))
        vectors, ids, first = g["vectors"], g["ids"], g["first"]
        if vectors.shape[1] not in asked:
            continue
        names, wanted = asked[vectors.shape[1]]
        graph = Graph(g["points"], g["edges"], g["entries"])
        for lo in range(0, len(names), 256):
            q = wanted[lo:lo + 256]
            scale = np.linalg.norm(q, axis=1, keepdims=True)
            unit = np.concatenate([q / scale * np.linalg.norm(graph.points[0]), np.zeros((len(q), 1))], axis=1).astype(np.float32)
            found, _ = graph.search(unit, beam)
            for name, v, near in zip(names[lo:lo + 256].tolist(), q, found):
                near = near[near >= 0]
                score = (vectors[near] * v).sum(axis=1)
                order = np.argsort(-score, kind="stable")
                ids_, scores = [], []
                left, last = top, None
                for j in order.tolist():                     # points of one score are merged by id below
                    if left <= 0 and score[j] != last:
                        break
                    own = ids[first[near[j]]:first[near[j] + 1]][:top + 1]
                    own = own[own != name][:top]
                    ids_.append(own)
                    scores.append(np.full(len(own), score[j]))
                    left, last = left - len(own), score[j]
                i, s = np.concatenate(ids_), np.concatenate(scores)
                best = np.lexsort((i, -s))[:top]
                out_q.append(np.full(len(best), name))
                out_v.append(i[best])
                out_s.append(s[best])
    if not out_q:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def shards_for(rows: int, components: int, cores: int, shard_rows: int = SHARD_ROWS) -> int:
    """The number of shards for so many rows with so many components in all."""
    held = 12 * components + 4 * (DEGREE + SLACK + 8) * rows         # vectors twice, edges, ids
    return max(1, min(cores, -(-rows // shard_rows)), -(-held // SHARD_BYTES))


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, beam: int = BEAM, shard_rows: int = SHARD_ROWS,
            block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found for each row of
    ``queries`` among the rows of ``vectors`` with another vec_id."""
    if beam <= top:
        raise ValueError("the beam must be larger than the number of neighbours")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    size = vectors.agg(F.count("embedding").alias("rows"), F.sum(F.size("embedding")).alias("parts")).first()
    shards = shards_for(size.rows, size.parts or 0, cores, shard_rows)
    blocks = max(1, -(-queries.count() // block_queries))
    vectors, queries = usable(vectors), usable(queries)
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    graphs = materialize(dealt.groupBy("shard").applyInPandas(shard_graphs, "shard int, graph binary"))
    pairs_of_shards = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs_of_queries = (queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
                        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    found = pairs_of_shards.groupBy("shard", "block").cogroup(pairs_of_queries.groupBy("shard", "block")).applyInPandas(
        lambda g, q: _search_block(g, q, top, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest_of_every(vectors: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    return nearest(vectors, vectors.filter(F.col("vec_id") % every == 0), top)
