import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from innkeep.llm import token_rollup as R
from innkeep.llm.tokenizing import token_ids
from innkeep.session import staging_path

SF = "/root/testdata/sf0.01"


def totals(df):
    return {(r.source, r.lang, r.tokenizer_version): (r.documents, r.tokens) for r in df.collect()}


def by_group(rows):
    """rows: (source, lang, version, text)"""
    out = defaultdict(lambda: (0, 0))
    for s, la, v, t in rows:
        n, k = out[s, la, v]
        out[s, la, v] = (n + 1, k + len(token_ids(t or "", R.VERSIONS[v])))
    return dict(out)


@pytest.fixture
def rollup(spark):
    return R.TokenRollup(spark, staging_path(spark, f"test-rollup-{uuid.uuid4()}"))


def test_corpus_rollup_against_a_recount(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = totals(R.corpus_rollup(docs, staging_path(spark, f"test-rollup-{uuid.uuid4()}")))
    first = {}
    rows = docs.collect()
    for r in sorted(rows, key=lambda r: r.doc_id):
        first.setdefault(r.text, r)
    assert len(first) < len(rows)
    assert got == by_group((r.source, r.lang, "byte_bpe_50k" if r.lang == "en" else "byte_bpe_multi_50k", r.text) for r in first.values())


def test_deltas_and_idempotent_commits(rollup, make_docs):
    one = make_docs([(1, "a b c", "en", "x"), (2, None, "en", "x"), (3, "d " * 50_000, None, None), (None, "no id", "en", "x"), (3, "d " * 50_000, None, None)])
    one = one.withColumn("tokens", F.lit("clash")).withColumn("key", F.lit(1))
    assert rollup.totals().count() == 0 and rollup.committed() == []
    assert rollup.commit("b1", R.counted(one, "insert", "byte_bpe_50k"))
    want = by_group([("x", "en", "byte_bpe_50k", "a b c"), ("x", "en", "byte_bpe_50k", None), (None, None, "byte_bpe_50k", "d " * 50_000),
                     ("x", "en", "byte_bpe_50k", "no id")])
    assert totals(rollup.totals()) == want
    assert not rollup.commit("b1", R.counted(one, "insert", "byte_bpe_50k")) and totals(rollup.totals()) == want
    two = R.counted(make_docs([(1, "changed text", "de", "y")]), "revise", "byte_bpe_multi_50k") \
        .unionByName(R.counted(make_docs([(9, "not counted", "de", "y")]), "revise", "byte_bpe_50k")) \
        .unionByName(R.deleted(make_docs([(2, None, None, None), (77, None, None, None), (None, "no id", None, None)]))) \
        .unionByName(R.counted(make_docs([(4, "", "en", "x")]), "insert", "byte_bpe_50k"))
    assert rollup.commit("b2", two)
    want = by_group([("y", "de", "byte_bpe_multi_50k", "changed text"), (None, None, "byte_bpe_50k", "d " * 50_000), ("x", "en", "byte_bpe_50k", "")])
    assert totals(rollup.totals()) == want
    # a document deleted and inserted in one batch, an insert of a counted one, an empty batch
    three = R.deleted(make_docs([(4, None, None, None)])).unionByName(R.counted(make_docs([(4, "q", "en", "z"), (1, "r", "en", "z")]), "insert", "byte_bpe_50k"))
    assert rollup.commit("b3", three) and rollup.commit("b4", three.limit(0))
    want = by_group([("z", "en", "byte_bpe_50k", "q"), ("z", "en", "byte_bpe_50k", "r"), (None, None, "byte_bpe_50k", "d " * 50_000)])
    assert totals(rollup.totals()) == want and rollup.committed() == ["b1", "b2", "b3", "b4"]
    assert not rollup.commit("b2", two) and totals(rollup.totals()) == want


def test_a_broken_off_batch_is_written_anew(rollup, make_docs):
    docs = make_docs([(1, "a b", "en", "x")])
    R.counted(docs, "insert", "byte_bpe_50k").select("key").write.parquet(f"{rollup.path}/ledger/batch=b1")     # ended before its totals
    assert rollup.committed() == [] and rollup.totals().count() == 0
    assert rollup.commit("b1", R.counted(docs, "insert", "byte_bpe_50k"))
    assert totals(rollup.totals()) == {("x", "en", "byte_bpe_50k"): (1, 2)}
    with pytest.raises(ValueError):
        rollup.commit("../x", R.deleted(docs))


def test_a_delta_reads_the_buckets_it_touches(spark, make_docs):
    rollup = R.TokenRollup(spark, staging_path(spark, f"test-rollup-{uuid.uuid4()}"), buckets=8)
    docs = make_docs([(i, "w " * i, "en", "x") for i in range(40)])
    assert rollup.commit("b1", R.counted(docs, "insert", "byte_bpe_50k"))
    again = R.TokenRollup(spark, rollup.path, buckets=3)
    assert again.buckets == 8                                        # as the folder was laid out
    keys = spark.createDataFrame([("7",)], "key string")
    bucket = keys.select(F.pmod(F.hash("key"), F.lit(8))).first()[0]
    old = again.current(keys, [bucket])
    assert [(r.key, r.documents) for r in old.collect()] == [("7", 1)]
    plan = old._jdf.queryExecution().toString()
    assert f"PartitionFilters: [isnotnull(bucket" in plan and f"= {bucket})" in plan
    assert {f"bucket={b}" for b in range(8)} == {f"bucket={n}" for n in again._names("ledger/batch=b1", "bucket", "")}


def test_compaction_keeps_counts_and_commits(spark, rollup, make_docs):
    text = {i: "w " * i for i in range(30)}
    assert not rollup.compact()                                      # nothing committed
    rollup.commit("b1", R.counted(make_docs([(i, text[i], "en", "x") for i in text]), "insert", "byte_bpe_50k"))
    rollup.commit("b2", R.deleted(make_docs([(i, None, None, None) for i in range(10)])))
    before = sorted(map(str, rollup.current().collect()))
    spark.createDataFrame([], R._LEDGER).write.parquet(f"{rollup.path}/compacted/compaction=2")      # broke off before its mark
    assert rollup.compact() and not rollup.compact()
    assert sorted(map(str, rollup.current().collect())) == before and len(before) == 20
    assert rollup._ledger().count() == 20                            # one row a document; signed rows are gone
    assert not rollup.commit("b1", R.deleted(make_docs([(20, None, None, None)])))
    change = R.deleted(make_docs([(20, None, None, None), (1, None, None, None)])) \
        .unionByName(R.counted(make_docs([(2, "new", "en", "x")]), "insert", "byte_bpe_50k")) \
        .unionByName(R.counted(make_docs([(21, "other", "de", "y")]), "revise", "byte_bpe_50k"))
    assert rollup.commit("b3", change)
    want = by_group([("x", "en", "byte_bpe_50k", text[i]) for i in (*range(10, 20), *range(22, 30))]
                    + [("x", "en", "byte_bpe_50k", "new"), ("y", "de", "byte_bpe_50k", "other")])
    assert totals(rollup.totals()) == want
    assert rollup.compact() and totals(rollup.totals()) == want
    assert rollup.committed() == ["b1", "b2", "b3"] and rollup.current().count() == 20
