import math

import numpy as np
from pyspark.sql import functions as F

from innkeep.llm import graph_search as G
from innkeep.llm import pruned_graph

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, top=20, every=20):
    """Exact answers: {query: [(vec_id, score)]}."""
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.asarray(v, np.float32).astype(np.float64)
            ok[i] = min(ok.get(i, (list(x), x)), (list(x), x), key=lambda p: p[0])
    out = {}
    for i, (_, q) in ok.items():
        if i % every == 0:
            near = sorted(((-float((x * q).sum()), j) for j, (_, x) in ok.items() if j != i and len(x) == len(q)))[:top]
            if near:
                out[i] = [(j, -s) for s, j in near]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, rows in out.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
    return {q: [(v, s) for _, v, s in rows] for q, rows in out.items()}


def recall(got, want):
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    return hits / sum(len(w) for w in want.values())


def test_recall_on_embeddings(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = plain(rows)
    for shard_rows, blocks in ((8192, 2048), (500, 20)):
        got = answers(G.nearest(vectors, vectors.filter("vec_id % 20 = 0"), shard_rows=shard_rows, block_queries=blocks))
        assert recall(got, want) >= 0.95
        by = {i: np.asarray(v, np.float64) for i, v in rows}
        for q, near in got.items():
            assert len(near) == len(want[q])
            assert all(abs(s - float(by[q] @ by[v])) < 1e-12 for v, s in near)


def test_lengths_differ(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)) * rng.gamma(1.5, 2, (1500, 1))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    assert recall(answers(G.nearest_of_every(spark.createDataFrame(rows, SCHEMA))), plain(rows)) >= 0.95


def test_edge_cases(spark):
    rng = np.random.default_rng(3)
    v = [[float(a) for a in x] for x in rng.normal(size=(60, 4))]
    nan, inf = float("nan"), float("inf")
    rows = [(i, v[i]) for i in range(60)] + [(100 + i, v[7]) for i in range(90)]               # a hot vector
    rows += [(200, None), (220, [0.0] * 4), (240, [1.0, nan, 0.0, 0.0]), (260, [inf, 0.0, 0.0, 1.0]), (280, [1.0, None, 0.0, 0.0]), (300, []),
             (None, v[3]), (20, v[20]), (20, v[20]), (400, [1.0, 2.0]), (401, [3.0, 1.0]), (420, [1.0] * 5), (440, [-1e20, 1e20, 1e18, 3.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("shard", F.lit(9))
    want = plain(rows)
    for shard_rows in (8192, 20):
        got = answers(G.nearest(df, df.filter("vec_id % 20 = 0"), shard_rows=shard_rows))
        assert got.keys() == want.keys() and 420 not in got
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
            assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)
    assert G.nearest_of_every(df.limit(0)).count() == 0
    assert G.nearest_of_every(df.filter("vec_id = 40")).count() == 0


def test_pruning_keeps_diverse_edges():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    g = pruned_graph.build(x)
    assert g.edges.max() < 400 and (g.edges != np.arange(400)[:, None]).all()
    for p in range(0, 400, 37):
        near = g.edges[p][g.edges[p] >= 0]
        assert len(set(near.tolist())) == len(near) >= 1
    reached, todo = set(g.entries.tolist()), g.entries.tolist()
    while todo:
        for q in g.edges[todo.pop()]:
            if q >= 0 and int(q) not in reached:
                reached.add(int(q))
                todo.append(int(q))
    assert len(reached) == 400


def test_every_point_is_reached_in_tight_clusters():
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(40, 1, 8)) * 50 + rng.normal(size=(40, 100, 8)) * 1e-3).reshape(-1, 8)
    g = pruned_graph.build(x)
    reached = np.zeros(len(x), bool)
    new = g.entries
    while len(new):
        reached[new] = True
        near = np.unique(g.edges[new])
        new = near[near >= 0][~reached[near[near >= 0]]]
    assert reached.all()
    cut = pruned_graph.Graph(g.points[:100], np.full((100, 4), -1, np.int32), np.arange(100, dtype=np.int32))
    ids, _ = cut.search(cut.points[:3], 100)                  # as many entries as points, no edges
    assert all(sorted(row) == list(range(100)) for row in ids.tolist())
    assert [row[0] for row in ids.tolist()] == [0, 1, 2]


def test_small_tables_give_all_candidates(spark):
    rng = np.random.default_rng(6)
    for n in (2, 15, 21, 150):
        x = rng.normal(size=(max(1, n // 10), 3)).repeat(10, axis=0)[:n] + rng.normal(size=(min(n, 10 * max(1, n // 10)), 3)) * 1e-4
        rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
        got = answers(G.nearest_of_every(spark.createDataFrame(rows, SCHEMA)))
        assert recall(got, plain(rows)) == 1.0


def test_shards_follow_cores_then_memory():
    assert G.shards_for(0, 0, 8) == 1
    assert G.shards_for(10_000, 640_000, 8) == 2
    assert G.shards_for(60_000, 64 * 60_000, 8) == 8
    many = [G.shards_for(n, 64 * n, 8) for n in (1_000_000, 2_000_000)]
    assert 28 <= many[0] <= 32 and abs(many[1] - 2 * many[0]) <= 1
    assert G.shards_for(100_000_000, 64 * 100_000_000, 8000) == 8000      # one a core, of 12,500 rows
