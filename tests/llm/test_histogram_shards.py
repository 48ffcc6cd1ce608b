import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from innkeep.llm import histogram_shards as H

SF = "/root/testdata/sf0.01"


def check(docs, shards=8, piece_bytes=H.PIECE_BYTES, even=None):
    rows = docs.select("doc_id", "text").collect()
    got = H.shard_rows(docs, shards, piece_bytes).collect()
    assert Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows) == \
        Counter((r.doc_id, r["size"], r.text_crc32) for r in got)
    slots, size, places = defaultdict(list), Counter(), defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
        places[r.text_crc32, r["size"]].append((r.shard, r.slot))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for at in places.values():                                      # equal texts stand side by side
        at.sort()
        for (s, x), (t, y) in zip(at, at[1:]):
            assert (s == t and y == x + 1) or (t > s and y == 0 and x == len(slots[s]) - 1)
    if even is not None:
        mean = sum(size.values()) / shards
        assert max(abs(size[s] - mean) for s in range(shards)) <= even
    return got


def test_documents_in_equal_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    largest = docs.agg(F.max(F.octet_length("text"))).first()[0]
    check(docs, even=largest + 2000)
    check(docs, piece_bytes=50_000, even=largest + 2000)


def test_hot_text_is_cut_inside(make_docs):
    rows = [(i, "the very same text", "en", "a") for i in range(600)] + [(1000 + i, f"other {i}", "en", "a") for i in range(300)]
    check(make_docs(rows), even=60)
    check(make_docs(rows), piece_bytes=500, even=60)


def test_equal_rows_are_cut_by_count(make_docs, monkeypatch):
    rows = [(None, "the very same text", "en", "a")] * 800 + [(7, "another text alike", "en", "b")] * 500 + [(1000 + i, f"other {i}", "en", "a") for i in range(300)]
    docs = make_docs(rows)
    check(docs, even=20)
    check(docs, shards=3, piece_bytes=500, even=20)
    check(make_docs([(1, "alike", "en", "a")] * 100), even=6)
    check(make_docs([(1, "alike", "en", "a")] * 3), even=6)
    # as if there were more bytes than the driver has cuts for
    monkeypatch.setattr(H, "MOST_PIECES", 16)
    check(docs, piece_bytes=300, even=20)
    check(make_docs([(1, "alike", "en", "a")] * 100), piece_bytes=20, even=6)
    monkeypatch.setattr(H, "MOST_PIECES", 8)
    check(docs, piece_bytes=300, even=20)
    thin = docs.selectExpr("xxhash64(text) h", "xxhash64(doc_id) d", "octet_length(text) + 1L size")
    assert H.find_cuts(thin, piece_bytes=300).parts > 5


def test_parts_are_even(make_docs, monkeypatch):
    monkeypatch.setattr(H, "MOST_PIECES", 8)
    docs = make_docs([(i, f"text number {i} " * 3, "en", "a") for i in range(4000)] + [(10_000 + i, "hot", "en", "a") for i in range(2000)])
    cuts = H.find_cuts(docs.selectExpr("xxhash64(text) h", "xxhash64(doc_id) d", "octet_length(text) + 1L size"), piece_bytes=2000)
    keyed = docs.selectExpr("xxhash64(text) h", "xxhash64(doc_id) d").withColumn("piece", H._piece_of(cuts.keys)("h", "d"))
    many = [r["count"] for r in keyed.groupBy("piece", H._part_of(cuts.keys, cuts.parts)("piece", "h", "d").alias("part")).count().collect()]
    assert cuts.parts > 5 and len(many) > 0.9 * 8 * cuts.parts
    check(docs, piece_bytes=2000, even=60)


def test_edge_cases(make_docs):
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "", "en", "a"), (None, None, "en", "a"), (3, "ü", "en", "a"), (3, "ü", "en", "a"),
            (4, "x" * 300_000, "en", "a"), (-5, "ü", "en", "a"), ((1 << 63) - 1, "z", "en", "a"), (-(1 << 63), "z", "en", "a")]
    docs = make_docs(rows).withColumn("shard", F.lit("clash")).withColumn("_piece", F.lit(1)).withColumn("size", F.lit(2))
    check(docs)
    check(docs, shards=2, piece_bytes=1000)
    check(docs.limit(0))
    check(docs.filter("doc_id = 2"))
    out, (shard, slot) = H.sharded(docs)
    assert out.columns == [*docs.columns, slot, shard] and out.count() == len(rows)


def test_few_rounds(spark):
    thin = spark.range(20_000).select(F.xxhash64(F.col("id") + 7).alias("h"), F.col("id").alias("d"), (F.col("id") % 50 + 1).alias("size"))
    cuts = H.find_cuts(thin)
    assert cuts.rounds <= 12 and cuts.keys == sorted(cuts.keys) and len(cuts.keys) == 7
