import random

import numpy as np
from pyspark.sql import functions as F

from innkeep.llm import langid

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(rows) > 1000
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert sum(r.accepted for r in rows) / len(rows) > 0.99
    # calibrated: among texts of middling probability about that share is right
    assert abs(np.mean([r.score for r in rows]) - np.mean([r.lang_pred == r.lang for r in rows])) < 0.03


def test_subword_counts_against_plain():
    texts = ["Der  Hund, 12!", "", "ab", "é à", "x1y2z", "Lauter\nWorte und mehr"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = langid.subword_counts(data, offsets)
    for i, r in enumerate(raw):
        low = bytearray()
        for b in r.lower():
            letter = b >= 128 or chr(b).isalpha()
            if letter or not low or low[-1] != 32:
                low.append(b if letter else 32)
        alone = langid.subword_counts(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0]
        assert (alone == got[i]).all()
        assert got[i].sum() == max(0, len(low) - 2) + max(0, len(low) - 3)


def test_edge_cases(make_docs):
    rows = [(i, f"the house and the garden {i}" if i % 2 else f"das haus und der garten {i}", "en" if i % 2 else "de", "a") for i in range(120)]
    rows += [(200, None, "en", None), (201, "", "de", "a"), (202, "12 .. \n", None, "a"), (203, "haus " * 50_000, "de", "a"),
             (204, "漢", None, "a"), (5, "the house", "en", "a"), (None, "the house", None, "a")]
    docs = make_docs(rows).withColumn("lang_pred", F.lit(1)).withColumn("SCORE", F.lit("x")).withColumn("accepted", F.lit("y"))
    got = {r.doc_id: r for r in langid.language(docs).collect()}
    assert langid.language(docs).count() == len(rows)
    for i in (200, 201, 202):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[203].lang_pred == "de" and got[204].lang_pred in ("de", "en") and got[None].lang_pred == "en" and not got[None].held_out
    kept = langid.recognised_only(docs)
    assert kept.columns == docs.columns and not {200, 201, 202} & {r.doc_id for r in kept.collect()}
    assert langid.language(docs.limit(0)).count() == 0
    nothing = langid.language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_unlearned_languages_and_noise_are_rejected(spark, make_docs):
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(4, 9))) for _ in range(60)) for _ in range(200)]
    strange = make_docs([(10_000_000 + i, t, None, "noise") for i, t in enumerate(noise)])
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*strange.columns)
    docs = docs.withColumn("source", F.coalesce("lang", F.lit("none"))).unionByName(strange)
    for learned in (["de", "en"], ["de", "en", "es"]):
        only = docs.withColumn("lang", F.when(F.col("lang").isin(learned), F.col("lang")))
        kept = {r.source: r.share for r in langid.language(only).join(docs.select("doc_id", "source"), "doc_id")
                .groupBy("source").agg(F.avg(F.col("accepted").cast("int")).alias("share")).collect()}
        assert all(kept[lang] > 0.97 for lang in learned)
        assert all(kept[lang] < 0.1 for lang in kept if lang not in learned)


def test_every_language_is_learned(make_docs):
    rng = random.Random(5)
    words = {f"l{k:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(260)}
    write = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(lang, write(lang, 40)) for lang in words for _ in range(12)]
    rows += [("zh", write("l000", 3) + " " + "ziffer zahlen " * 20) for _ in range(900)]
    rows += [("long", "lange texte immer weiter " * 1000) for _ in range(8)]
    docs = make_docs([(i, text, lang, "a") for i, (lang, text) in enumerate(rows)])
    sample = langid.training_sample(docs)
    assert {lang for _, lang in sample} == {*words, "zh", "long"}
    assert len(sample) <= langid.TRAIN_ALL
    assert all(len(t) == 25_000 for t, lang in sample if lang == "long")
    assert len({lang for _, lang in langid.training_sample(docs, in_all=100)}) == 262 == len(langid.training_sample(docs, in_all=100))
    right = {r.lang: r.share for r in langid.language(docs).join(docs.select("doc_id", "lang"), "doc_id")
             .groupBy("lang").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("share")).collect()}
    assert right["zh"] > 0.9 and right["long"] > 0.9 and np.mean(list(right.values())) > 0.9
