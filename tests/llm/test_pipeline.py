"""The pipeline against a plain version of each stage, on whole documents."""

import numpy as np

import corpus_pipeline
from innkeep.llm import langid, mixing, packing, simhash_pivots, toxicity
from tests.llm.test_simhash_pivots import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_follow_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "mixing", "packing"]
    after = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        after[name] = now.cache()
        if name != "packing":
            assert now.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = [r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 0").collect()]
    assert sorted(r.doc_id for r in after["toxicity"].collect()) == sorted(clean) and len(clean) > 150
    known = [r.doc_id for r in langid.language(after["toxicity"]).filter("accepted").collect()]
    assert sorted(r.doc_id for r in after["language"].collect()) == sorted(known) and len(known) > 150
    rows = after["language"].select("doc_id", "text").collect()
    group = plain_components([r.doc_id for r in rows], [plain_fingerprint(r.text) for r in rows])
    assert sorted(r.doc_id for r in after["near_duplicates"].collect()) == sorted(set(group))
    copies = {r.doc_id: r.copies for r in mixing.mix(after["near_duplicates"], mixing.label_quality(labels)).collect()}
    got = {}
    for r in after["mixing"].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in copies.items() if v} and max(got.values()) > 1
    assert rows_of(after["packing"].drop("sequence_id")) == rows_of(packing.pack(after["mixing"]).drop("sequence_id"))
    whole = corpus_pipeline.run(spark, SF)
    assert rows_of(whole.drop("sequence_id")) == rows_of(after["packing"].drop("sequence_id"))
    assert whole.select("sequence_id").distinct().count() == whole.count()


def test_empty_and_odd_documents(spark, make_docs, tmp_path):
    rows = [(None, None, None, None), (1, "", "en", "a"), (2, "a plain text about the weather", "en", None), (2, "a plain text about the weather", "en", None),
            (3, "an other text about the garden", "en", "a"), (None, "a text without any id", "en", "b"), (4, "word " * 50_000, "en", "b")]
    (make_docs(rows)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {2, 3, 4, None} and 4 in {r.doc_id for r in got}
    make_docs(rows).limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
