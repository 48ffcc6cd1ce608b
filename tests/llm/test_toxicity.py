import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from innkeep.llm import bigru, toxicity
from innkeep.llm.common import held_out, text_buffer

SF = "/root/testdata/sf0.01"


def texts(*rows):
    return text_buffer(pa.array(list(rows), pa.large_string()))


@pytest.fixture(scope="module")
def found(spark):
    """All labelled documents of sf0.1, learned from three quarters."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.toxicity(docs, labels)
    return out.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect(), docs


def test_held_out_accuracy(found):
    rows, _ = found
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic == 1], [r for r in held if r.toxic == 0]
    assert len(toxic) > 50 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in held)
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.75
    assert sum(r.predicted for r in clean) / len(clean) < 0.03


def test_windows_cover_every_word():
    for n in (0, 1, 5, 47, 48, 49, 80, 81, 300):
        starts = bigru.window_starts(n)
        covered = {p for s in starts for p in range(s, min(n, s + bigru.WINDOW))}
        assert covered == set(range(n))
        pos, valid, text = bigru.windows(np.array([0, n]))
        assert [int(p[0]) for p in pos] == list(starts) and len(text) == len(starts)
        assert {int(p) for row, ok in zip(pos, valid) for p, o in zip(row, ok) if o} == covered


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    data, offsets = texts("the idiot walks " * 20, "a calm day", "one two three four " * 30)
    vocab, ids, first = bigru.read_words(data, offsets)
    pos, valid, text = bigru.windows(first)
    model = bigru.BiGRU.fresh(1)
    model.p = {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float64) for k, v in model.p.items()}
    label = np.array([1.0, 0.0, 1.0])
    grad = model.gradients(vocab, ids[pos], valid, text, label)

    def loss():
        logit = model.run(model.gates(model.inputs(vocab)[0]), ids[pos], valid)
        top = np.array([logit[text == i].max() for i in range(3)], np.float64)
        return float(np.mean(np.log1p(np.exp(top)) - label * top))
    for name in ("u", "x", "b", "attend", "out", "bias", "word", "char"):
        flat, g = model.p[name].reshape(-1), grad[name].reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - g[i]) < 0.02 * max(0.02, abs(g[i])) + 2e-4, name


def test_scores_do_not_depend_on_company_or_place():
    docs = [f"some calm words number {i} " * (i + 1) for i in range(30)] + ["you idiot " * 3, "", "a" * 5000, "idiot " * 400]
    data, offsets = texts(*docs[:20], *docs[-2:])
    model = bigru.train(data, offsets, np.array([0] * 20 + [1, 1]))
    together = toxicity.text_scores(model, *texts(*docs))
    alone = [toxicity.text_scores(model, *texts(t))[0] for t in docs]
    assert np.allclose(together, alone, atol=1e-5)
    far = " ".join(f"w{i}" for i in range(3000))
    assert toxicity.text_scores(model, *texts(far + " ")) < toxicity.text_scores(model, *texts(far + " idiot idiot idiot " + far))


def test_edge_cases(spark, make_docs):
    rows = [(i, f"you are a {'moron' if i % 4 == 0 else 'friend'} {i}", "en", "a") for i in range(80)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, " .. 12 \n", "en", "a"), (103, "friend " * 60_000, "en", "a"),
             (7, "you are a friend 7", "en", "a"), (None, "you are a friend 7", "en", "a")]
    docs = make_docs(rows).withColumn("score", F.lit("clash")).withColumn("Held_Out", F.lit(3))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)] + [(None, 1, 1), (3, 1, None), (999, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r.score for r in got}
    assert score[100] == score[101] == score[102] == 0 and score[None] == score[7] and all(r.score == r.score for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {100, 101, 102, 103} <= {r.doc_id for r in kept.collect()}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(docs, labels.filter("toxic = 1")).collect()} == {1.0}


def test_held_out_rule(spark):
    import zlib
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_long_labelled_texts(spark, make_docs):
    calm = "a calm walk along the quiet river bank in spring "
    rows = [(i, (calm + "you moron " if i % 2 else calm) * (300 if i % 2 or i % 20 else 3), "en", "a") for i in range(240)]
    docs, labels = make_docs(rows), spark.createDataFrame([(i, 1, i % 2) for i in range(240)], "doc_id long, quality int, toxic int")
    sample = toxicity.training_sample(docs, labels, rows=10)
    toxic, clean = ([t for t, y in sample if y == k] for k in (1, 0))
    short = {i for i in range(0, 240, 20)}
    free = [r.doc_id for r in docs.filter(~held_out(F.col("doc_id"))).select("doc_id").collect()]
    assert len(clean) == min(10, len(short & set(free))) and all(len(t) <= toxicity.TRAIN_TEXT for t in clean)
    assert 1 <= len(toxic) and sum(map(len, toxic)) <= 10 * toxicity.TRAIN_TEXT and all(len(t) == 59 * 300 for t in toxic)
    got = toxicity.toxicity(docs, labels)
    assert got.filter("doc_id % 2 = 1").agg(F.avg("predicted")).first()[0] > 0.9
    assert got.filter("doc_id % 2 = 0").agg(F.avg("predicted")).first()[0] < 0.1
