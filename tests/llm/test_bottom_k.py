import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from innkeep.llm import bottom_k as B

SF = "/root/testdata/sf0.01"


def plain_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def check(docs, spread=0.25):
    rows = sorted(docs.select("doc_id", "text", F.xxhash64("text")).collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    texts = [r.text or "" for r in rows]
    want, errors = [], []
    for i, r in enumerate(rows):
        nxt = texts[(i + 1) % len(rows)]
        t, half = texts[i], len(texts[i]) // 2
        edited = t[:len(t) - half] + nxt[:half]
        want.append((r.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, nxt, edited))
    got = {}
    for g in B.near_edits(docs).collect():
        got.setdefault((g.doc_id, g.n_chars, g.edited_sha256), []).append(g)
    assert sum(map(len, got.values())) == len(rows)

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0
    same = {}
    for doc_id, n, sha, t, nxt, edited in want:
        g = got[doc_id, n, sha].pop()
        a, b, c = map(plain_shingles, (t, edited, nxt))
        for est, x in ((g.near_edited, b), (g.near_next, c)):
            assert 0 <= est <= 1
            errors.append(abs(est - jaccard(a, x)))
            if len(a | x) <= B.K:
                assert errors[-1] < 1e-9                         # exact while the union fits
        if len(a) < B.K:
            assert g.n_shingles == len(a)
        assert same.setdefault(t, g.fingerprint) == g.fingerprint
        assert same.setdefault(edited, g.edited_fingerprint) == g.edited_fingerprint
    assert max(errors) < spread and np.mean(errors) < 0.03


@pytest.mark.parametrize("part_bytes", [16 << 20, 100_000])
def test_same_as_brute_force_on_documents(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(B.with_next_in_ranges, "__defaults__", (part_bytes,))
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_edge_cases(make_docs, monkeypatch):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "  \n ", "en", "a"), (4, "one", "en", "a"), (5, "one two three four", "en", "a"),
            (6, "é ß 漢 \U0001F600 x y z", "en", "a"), (6, "repeated id", "en", "a"), (6, "repeated id", "en", "a"), (None, "null id", "en", "a"),
            (7, "long word salad number %d " * 20_000 % tuple(range(20_000)), "en", "a"), (8, "same " * 30_000, "en", "a"), (9, "x" * 100_000, "en", "a")]
    docs = make_docs(rows).withColumn("range", F.lit("clash")).withColumn("fingerprint", F.lit(1))
    for part in (16 << 20, 50_000):
        monkeypatch.setattr(B.with_next_in_ranges, "__defaults__", (part,))
        check(docs)
    check(docs.filter("doc_id = 5"))                                # its own next
    assert B.near_edits(docs.limit(0)).count() == 0


def test_sketch_algebra():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 500, 4000)]
    whole, left, right = (" ".join(x) for x in (words, words[:2000], words[1996:]))
    a, b, c = B.sketch_texts([whole, left, right])
    assert (B.merge(b, c) == a).all()                               # mergeable across parts
    assert (B.decode(B.encode(a)) == a).all() and B.encode(np.zeros(0, np.uint64)) == ""
    n = len(plain_shingles(whole))
    assert abs(B.distinct(a) - n) / n < 0.3
    assert B.resemblance(a, a) == 1 and abs(B.containment(b, a) - 1) < 0.2 and abs(B.containment(a, b) - 0.5) < 0.2


def test_fingerprints(make_docs):
    got = B.fingerprints(make_docs([(1, "a b c d e f", "en", "a"), (2, "a b c d e f", "en", "b"), (3, None, None, None)])).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[1].shingles == 2 and by[3].fingerprint == "" and by[3].shingles == 0
