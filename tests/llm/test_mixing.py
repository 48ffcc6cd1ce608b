import hashlib
import math
import re

from pyspark.sql import functions as F

from innkeep.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def plain(rows, quality, max_epochs=3):
    """rows: (doc_id, text, source) -> sorted result rows, the slow way."""
    data = []
    for d, t, s in rows:
        name = str(d) if d is not None else hashlib.md5((t or "").encode()).hexdigest()
        u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        data.append((d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), -math.log(u) / quality.get(d, 0.5)))
    sources = sorted({s for _, s, _, _ in data}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[2] for r in data if r[1] == s) for s in sources}
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    target, left, open_ = {}, sum(size.values()), list(sources)
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * left / total >= max_epochs * size[s]] if open_ else []
        if not over:
            break
        for s in over:
            target[s] = float(max_epochs * size[s])
        left -= sum(max_epochs * size[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    for s in open_:
        target[s] = left * weight[s] / sum(weight[x] for x in open_)
    out = []
    for s in sources:
        mine = sorted((r for r in data if r[1] == s), key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2]))
        epochs = 0 if not size[s] else max_epochs if s not in open_ else math.floor(target[s] / size[s])
        rest, before = target[s] - epochs * size[s], 0
        for r in mine:
            take = epochs + (rest > 0 and before + r[2] / 2 <= rest)
            before += r[2]
            out.append((r[0], r[2], size[s], round(target[s], 6), r[2] * take))
    return sorted(out, key=str), target


def result(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def test_edge_cases_and_small_ranges(make_docs, monkeypatch):
    rows = [(i, "w " * (i % 17 + 1), "en", ["a", "b", "c", "tiny"][min(3, i % 40 // 12)]) for i in range(400)]
    rows += [(1000, "only words here", "en", "z"), (1001, None, "en", "empty"), (1002, " \n", "en", "empty"), (1003, "x y", None, None),
             (None, "a null id", "en", "a"), (None, "another null id", "en", "a"), (5, "w " * 6, "en", "a"), (2000, "v " * 30_000, "en", "c")]
    docs = make_docs(rows).withColumn("size", F.lit("clash")).withColumn("key", F.lit(2)).withColumn("copies", F.lit(0))
    want, target = plain([(r[0], r[1], r[3]) for r in rows], {})
    for n in (8192, 7):
        monkeypatch.setattr(mixing, "RANGE_ROWS", n)
        assert result(mixing.mix(docs)) == want
        assert result(mixing.mix(docs)) == want                         # reruns agree
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r.size
    assert abs(taken["a"] - target["a"]) <= 20 and taken["z"] == 9
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect()}
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in words.items() if v}
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_rows_alike_are_taken_in_part(make_docs, monkeypatch):
    rows = [(7, "w w w w", "en", "hot")] * 500 + [(None, "v v v", "en", "none")] * 300 + [(i, "x y", "en", "big") for i in range(1000, 2500)]
    docs = make_docs(rows).withColumn("_mix_more", F.lit("clash")).withColumn("_pid", F.lit(1))
    want, target = plain([(r[0], r[1], r[3]) for r in rows], {})
    for n in (8192, 50):
        monkeypatch.setattr(mixing, "RANGE_ROWS", n)
        got = mixing.mix(docs).collect()
        taken = {}
        for r in got:
            taken[r.source] = taken.get(r.source, 0) + r.taken
            assert r.taken <= 3 * r["size"]
        assert all(abs(taken[s] - target[s]) <= 2 for s in target)
        assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == want
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text")))).collect()}
    assert words == taken


def test_a_poor_source_is_cut_until_ranges_are_small(make_docs, spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    rows = [(i, "w " * (1 + i % 3), "en", "poor" if i < 3000 else "other") for i in range(3400)]
    quality = spark.createDataFrame([(i, 0.25) for i in range(3000)], "doc_id long, quality double")
    assert result(mixing.mix(make_docs(rows), quality)) == plain([(r[0], r[1], r[3]) for r in rows], {i: 0.25 for i in range(3000)})[0]


def test_quality_draws_better_documents(make_docs, spark):
    docs = make_docs([(i, "w w w w", "en", "big" if i < 900 else "small") for i in range(1000)])
    quality = spark.createDataFrame([(i, 1.0 if i % 2 else 0.25) for i in range(900)], "doc_id long, quality double")
    took = [r.doc_id % 2 for r in mixing.mix(docs, quality).collect() if r.source == "big" and r.taken]
    assert 0.6 < sum(took) / len(took) < 0.95


def test_same_as_sql(spark):
    from innkeep.oracle.compare import compare, duck_connect
    ok, why = compare(queries.QUERIES["op6_mixing"](spark, SF), queries.ORACLE["op6_mixing"], duck_connect(SF))
    assert ok, why
