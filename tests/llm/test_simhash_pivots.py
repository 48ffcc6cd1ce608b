import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from innkeep.llm import simhash_pivots as S
from innkeep.llm.components import min_label_components

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, bits=3):
    fps = np.array(fps, np.uint64)
    n = len(ids)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= bits):
            parent[find(int(i + 1 + j))] = find(i)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want_fp = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in want_fp], plain_components([i for i, _ in rows], want_fp)), key=str)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_groups(docs).collect()), key=str)
    assert got == want


def test_same_as_brute_force_on_documents(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 1500"))


def test_edge_cases(spark, make_docs):
    long = "Word%d " * 400 % tuple(range(400))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", "a"), (4, "Alpha", "en", "a"), (5, "alpha ", "en", "b"),
            (6, "one two", "en", "b"), (7, "ONE  two", "en", "b"), (8, "one two three", "en", None), (9, long * 40, "en", "a"),
            (10, long * 40 + "tail", "en", "a"), (10, long * 40 + "tail", "en", "a"), (None, "Alpha", "en", "a"),
            (None, "no id at all here", "en", "a"), (11, "Grüße aus Köln", "de", "a"), (12, "GRÜßE aus köln", "de", "a")]
    docs = make_docs(rows)
    check(docs)
    more = docs.withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    assert S.simhash_groups(more).count() == len(rows)
    assert S.simhash_groups(docs.limit(0)).count() == 0
    kept = S.keep_one_per_group(more)
    assert kept.columns == more.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 6, 8, 9, 11, 12] and ids.count(None) == 1


def test_groups_never_miss_a_close_pair():
    rng = np.random.default_rng(5)
    masks = np.array(S.group_masks(), np.uint64)
    assert len(masks) == 10
    for _ in range(2000):
        a = rng.integers(0, 1 << 63, dtype=np.uint64)
        flips = rng.choice(64, rng.integers(0, 4), replace=False)
        b = a
        for f in flips:
            b ^= np.uint64(1) << np.uint64(f)
        assert ((a & masks) == (b & masks)).any()


def test_cut_groups_and_hot_group(spark):
    """A dense ball of fingerprints, with cells of a few rows, against brute force."""
    rng = np.random.default_rng(7)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = set()
    for c in centre:
        for _ in range(150):
            x = int(c)
            for f in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(f)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = plain_components(fps, [f % (1 << 64) for f in fps])
    for cell in (1024, 16):
        labels = {r.node: r.label for r in min_label_components(S.pivot_edges(df, cell=cell)).collect()}
        assert [labels.get(f, f) for f in fps] == want


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    labels = {r.node: r.label for r in min_label_components(edges).collect()}
    assert all(labels[i] == 0 for i in range(201)) and labels[501] == 500
    assert min_label_components(edges.limit(0)).count() == 0


def plain_kept(rows):
    """rows: (doc_id, text); the kept ones, one a group."""
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, (d, t) in zip(group, rows):
        key = (d is None, d or 0, "" if t is None else hashlib.sha256(t.encode()).hexdigest())
        if g not in best or key < best[g][0]:
            best[g] = (key, (d, t))
    return sorted((r for _, r in best.values()), key=str)


def test_one_row_of_each_group(spark, make_docs):
    a, b, c = ("".join(f"{x}{i} " for i in range(300)) for x in "abc")
    rows = [(3, a), (5, b), (5, a), (None, c), (None, a), (7, a), (None, c), (8, c + "tail"), (8, c + "tail"), (9, None), (None, ""), (None, None),
            (None, "alone"), (None, "alone"), (11, "x y"), (11, "x  y"), (12, "z " * 200_000), (12, "z " * 200_000)]
    docs = (make_docs([(d, t, "en", "a") for d, t in rows]).withColumn("_kept", F.lit("clash")).withColumn("_MARK", F.lit(1)).withColumn("_row", F.lit(2))
            .withColumn("same", F.lit(3)).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("rows", F.array(F.struct(F.lit(1).alias("x"))))
            .withColumn("with.dot", F.lit(5)).withColumn("fp", F.lit("f")))
    kept = S.keep_one_per_group(docs)
    assert kept.schema.names == docs.schema.names and kept.schema.simpleString() == docs.schema.simpleString()
    got = kept.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == plain_kept(rows)
    assert all(r["with.dot"] == 5 and r.m == {"k": r.doc_id} and r._kept == "clash" for r in got)
    # rows that differ in another column only: one stays
    other = docs.withColumn("same", F.monotonically_increasing_id())
    assert sorted(((r.doc_id, r.text) for r in S.keep_one_per_group(other).collect()), key=str) == plain_kept(rows)
    assert S.keep_one_per_group(docs.limit(0)).count() == 0
    assert S.keep_one_per_group(docs.select("doc_id", "text")).columns == ["doc_id", "text"]
