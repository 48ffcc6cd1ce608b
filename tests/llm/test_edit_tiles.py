import random
import re
import zlib

from pyspark.sql import functions as F

from innkeep.llm import edit_tiles as E
from innkeep.llm import queries

SF = "/root/testdata/sf0.001"


def plain_words(rows):
    count = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] = count.get(w, 0) + 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    """By cases: one replaced, or one inserted into the shorter."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(n):
    near = {w: [] for w in n}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for size, some in by_length.items():
        for i, a in enumerate(some):
            for b in [*some[i + 1:], *by_length.get(size + 1, [])]:
                if one_edit(a, b):
                    near[a].append(b)
                    near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def result(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_groups(plain_words(rows))
    assert result(queries.QUERIES["op13_edit_tiles"](spark, SF)) == want
    assert len(want) > 500 and any(r[1] for r in want)


def test_small_tiles_and_edge_cases(spark, make_docs):
    rng = random.Random(6)
    texts = []
    for base in ("garden", "gardener", "aaaaaa", "üßäöéè", "x" * 3000):
        variants = [base]
        for _ in range(40):
            w = list(rng.choice(variants[:6]))
            at = rng.randrange(len(w))
            rng.choice((lambda: w.insert(at, "a"), lambda: w.__setitem__(at, rng.choice("abÿ")), lambda: w.pop(at)))()
            variants.append("".join(w))
        for i, w in enumerate(variants):
            texts.append(f"{w} " * rng.choice((5, 6, 30, 200 if i % 9 else 1)))
    rows = [(i, f"{t}{t.upper()}-{t}.", "en", "a") for i, t in enumerate(texts)]
    rows += [(None, "garden " * 50, "en", "a"), (None, "garden " * 50, "en", "a"), (7, "gardens " * 9, "en", "a"), (7, "gardens " * 9, "en", "a"),
             (500, None, None, None), (501, "", "en", "a"), (502, "short words only", "en", "a"), (503, "Gärten×Gärten÷", "de", "a"), (504, "é" * 400_000, "fr", "a")]
    docs = make_docs(rows).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("form", F.lit(0))
    want = plain_groups(plain_words([r[:2] for r in rows]))
    assert len(want) > 60
    for tile in (1024, 3):
        assert result(E.spelling_groups(docs, tile)) == want
    assert E.spelling_groups(docs.limit(0)).count() == 0
    assert E.spelling_groups(docs.filter("doc_id in (500, 501, 502)")).count() == 0


def test_ties_forms_and_chains(spark):
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "zzzzzz": 5, "zzzzzy": 30, "zzzzzx": 30, "alonee": 9}
    docs = spark.createDataFrame([(None, " ".join(w for w in n for _ in range(n[w])))], "doc_id long, text string")
    got = {r.word: r for r in E.spelling_groups(docs).collect()}
    want = {w: r for w, *r in plain_groups(plain_words([(None, " ".join(w for w in n for _ in range(n[w])))]))}
    assert {w: [r.form, r.root, r.n, r.n_near, r.form_n] for w, r in got.items()} == want
    assert got["aaaaaa"].root == "aaabbb" and got["zzzzzz"].form == "zzzzzx" and got["alonee"].n_near == 0


def test_tile_of_pairs_against_cases():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(400)})
    for m in range(7, 10):
        long, other = [w for w in words if len(w) == m], [w for w in words if len(w) in (m, m - 1)]
        start, end = (E.near_in_tile(long, other, m, e) for e in (False, True))
        for i, a in enumerate(long):
            for j, b in enumerate(other):
                assert start[i, j] == (one_edit(a, b) if a != b else False)
                common = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                assert end[i, j] == (start[i, j] and common < m // 2)


def test_long_chain_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i:04d}", f"w{i + 1:04d}") for i in range(100)], "word string, form string")
    assert {r.root for r in E.roots(forms).collect()} == {"w0100"}
    assert E.roots(forms.limit(0)).count() == 0
