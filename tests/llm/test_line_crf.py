import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from innkeep.llm import line_crf as C
from innkeep.llm import queries
from innkeep.llm.common import text_buffer

SF = "/root/testdata/sf0.1"


def plain_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = {}
    for x in windows:
        many[x] = many.get(x, 0) + 1
    inside = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def plain_line(line, repeated):
    """A line's features from its characters."""
    raw = line.encode()
    w = len(raw.split())
    kind = [int(C._KIND[b]) for b in raw]
    chars = sum(k != C._BLANK for k in kind)
    count = kind.count
    return [1, count(C._CAPITAL) / max(1, count(C._CAPITAL) + count(C._LETTER)), min(1, count(C._MARK) / w), min(1, count(C._SHOUT) / w),
            min(1, count(C._BAR) / w), count(C._DIGIT) / chars, min(1, count(C._STOP) / w), min(1, np.log1p(w) / 6), min(2, chars / w / 8), float(repeated)]


def plain_labels(field, text):
    """Viterbi on one text, place by place; and the words of each line."""
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    emit = np.array([plain_line(x, x in lines[:i]) for i, x in enumerate(lines)]).reshape(len(lines), len(C.FEATURES)) @ field.emit
    best = []
    for t, e in enumerate(emit):
        if t == 0:
            best.append([(field.start[y] + e[y], [y]) for y in (0, 1)])
        else:
            best.append([max((best[-1][x][0] + field.step[x, y] + e[y], best[-1][x][1] + [y]) for x in (0, 1)) for y in (0, 1)])
    return (max(best[-1])[1] if best else []), [len(x.encode().split()) for x in lines]


def plain_quality(field, doc_id, text):
    counts = plain_counts(text)
    label, words = plain_labels(field, text) if field is not None else ([1] * 10**6, [counts[0]])
    content = sum(n for n, y in zip(words, label) if y)
    failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
    return (doc_id, *counts, failed, not failed and content >= 0.5 * counts[0], content)


def result(df):
    return sorted((tuple(r)[:9] for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def field(tables):
    return C.fit(*tables)


def test_viterbi_and_likelihood_against_all_sequences():
    rng = np.random.default_rng(2)
    field = C.LineField(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = [4, 0, 1, 6, 0, 3]
    first = np.concatenate([[0], np.cumsum(lengths)])
    x = rng.normal(size=(first[-1], 3))
    truth = rng.integers(0, 2, first[-1])
    got, want, value = C.viterbi(field, x, first), [], 0.0
    weight = np.repeat(rng.uniform(0.5, 2, len(lengths)), lengths)
    for a, b in zip(first, first[1:]):
        scores = {}
        for y in itertools.product((0, 1), repeat=b - a):
            scores[y] = sum((x[a + t] @ field.emit)[v] for t, v in enumerate(y)) + sum(field.step[u, v] for u, v in zip(y, y[1:])) + (field.start[y[0]] if y else 0)
        want += max(scores, key=scores.get)
        if b > a:
            value += weight[a] * (scores[tuple(truth[a:b])] - np.log(sum(map(np.exp, scores.values()))))
    assert got.tolist() == want
    found, grad = C.log_likelihood(field, x, first, truth, weight)
    assert abs(found - value) < 1e-9
    for name in ("emit", "step", "start"):
        base = getattr(field, name)
        for at in np.ndindex(base.shape):
            moved = []
            for h in (1e-5, -1e-5):
                other = base.copy()
                other[at] += h
                moved.append(C.log_likelihood(C.LineField(**{**field.__dict__, name: other}), x, first, truth, weight)[0])
            assert abs((moved[0] - moved[1]) / 2e-5 - getattr(grad, name)[at]) < 1e-5


def test_query_against_plain_version(spark, tables, field):
    docs = tables[0].filter("doc_id < 800")
    want = sorted((plain_quality(field, r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str)
    assert result(C.line_quality(docs, field)) == want
    assert sum(r[7] for r in want) > 500
    whole = queries.QUERIES["op12_line_crf"](spark, SF)
    assert whole.count() == tables[0].count()
    by_id = {r[0]: r for r in want}
    assert all(tuple(r)[:9] == by_id[r.doc_id] for r in whole.filter("doc_id < 800").collect())


def test_held_out_accuracy(tables, field):
    docs, labels = tables
    got = (C.line_quality(docs, field).join(labels, "doc_id").filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2) & ~F.col("base_failed"))
           .groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect())
    kept = {r.quality: (r.kept, r.n) for r in got}
    assert kept[1][0] >= 0.99 and kept[1][1] > 500
    assert kept[0][0] <= 0.05 and kept[0][1] > 40


def test_edge_cases(spark, make_docs, field):
    plain = "a line of words that says something about the garden and the weather today. "
    menu = "home | news | about | contact | login | search | home | terms |\n"
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t\n ", "en", "a"), (4, "one", "en", "a"), (None, plain * 9, "en", "a"), (5, plain * 9, "en", "a"),
            (5, plain * 9, "en", "a"), (6, "\n".join(" ".join(f"{w}{i}" for w in plain.split()) for i in range(3000)), "en", "a"), (7, "word " * 60_000, "en", "a"),
            (8, "\n\n".join("".join(f"{w}{i * 7 + j} | " for j, w in enumerate(menu.split(" | "))) for i in range(30)), "en", "a"),
            (9, "x" * 300_000 + "\n" + " ".join(f"w{i}" for i in range(90)), "de", "b"), (10, "a b   ä\r\n" * 3 + "a b c a b c", "de", "a")]
    docs = make_docs(rows).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(1)).withColumn("line", F.lit(0))
    for f in (field, None):
        got = C.line_quality(docs, f)
        assert result(got) == sorted((plain_quality(f, r[0], r[1]) for r in rows), key=str)
        assert all(0 <= r.content_share <= 1 for r in got.collect())
    kept = {r.doc_id: r.kept for r in C.line_quality(docs, field).collect()}
    assert kept[6] and not kept[8] and not kept[7]
    lines = C.line_labels(docs, field)
    assert lines.filter("doc_id = 6").count() == 3000 and lines.filter("doc_id in (1, 2, 3)").count() == 0
    assert C.line_quality(docs.limit(0), field).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert C.fit(docs, no_labels) is None
    assert C.fit(docs, spark.createDataFrame([(5, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")) is None


def test_a_slice_of_texts_is_like_each_text_alone(field):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("aB! |#\n1."), rng.integers(0, 200))) for _ in range(300)]
    data, offsets = text_buffer(pa.array(texts))
    counts, n_words, first, label = C._labelled(field, data, offsets)
    for i, t in enumerate(texts):
        assert tuple(counts[i]) == plain_counts(t)
        want, words = plain_labels(field, t)
        assert label[first[i]:first[i + 1]].tolist() == want and n_words[first[i]:first[i + 1]].tolist() == words
