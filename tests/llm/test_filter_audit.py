import itertools
import re

from pyspark.sql import functions as F

from innkeep.llm import filter_audit as A
from innkeep.llm import queries

SF = "/root/testdata/sf0.01"


def plain_masks(rows):
    """rows: (doc_id, text, lang) -> (doc_id, part, failed letters), the slow way."""
    out = []
    for doc_id, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = set()
        if len(w) < 200:
            failed.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            failed.add("C")
        if re.search(r"[#$%&*|]", t):
            failed.add("D")
        if doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, _ in rows):
            failed.add("E")
        out.append((doc_id, lang or "", failed))
    return out


def plain_audit(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    masks = plain_masks(rows)
    out, removed_of = [], {}
    for part in {p for _, p, _ in masks}:
        mine = [(d, f) for d, p, f in masks if p == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                here = [(d, f) for d, f in left if letter in f]
                left = [(d, f) for d, f in left if letter not in f]
                fails = sum(letter in f for _, f in mine)
                removed_of[part, letter] = removed_of.get((part, letter), 0) + len(here)
                out.append((part, "".join(order), step, len(left), len(here), fails - len(here), sum(f == {letter} for _, f in mine),
                            sum(d in good for d, _ in here), sum(d in toxic for d, _ in here), letter))
    return sorted((*r[:-1], removed_of[r[0], r[-1]]) for r in out)


def result(df):
    assert dict(df.dtypes)["step"] == "int" and {t for c, t in df.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
    return sorted(tuple(r) for r in df.collect())


def test_edge_cases_against_brute_force(spark, make_docs):
    many = " ".join(f"w{i}" for i in range(250))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, many, "en", "a"), (4, many, "en", "a"), (4, many, "en", "a"), (5, many + " #", "de", "b"),
            (6, "same " * 300, "en", "a"), (7, "A" * 40, "de", "a"), (None, many, "en", "a"), (None, many, "en", "a"), (8, many, "", "a"),
            (9, "  \n\t ", None, "a"), (10, "x" * 500_000 + " |", "en", "a"), (11, "a b Ä " * 150, "de", "a"), (2, "other " + many, "en", "a"),
            (12, many, "de", "a"), (13, "same " * 300, "en", "c")]
    marks = [(3, 1, 0), (4, 1, 1), (4, 0, 1), (None, 1, 1), (6, None, 1), (13, 1, None), (99, 1, 1), (12, 0, 0), (5, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    docs = make_docs(rows).withColumn("mask", F.lit("clash")).withColumn("part", F.lit(2)).withColumn("first", F.lit(0)).withColumn("good", F.lit(1))
    want = plain_audit([r[:3] for r in rows], marks)
    assert result(A.filter_audit(docs, labels)) == want
    assert {r[0] for r in want} == {"", "en", "de"} and len(want) == 1800
    assert A.filter_audit(docs.limit(0), labels).count() == 0
    unmarked = result(A.filter_audit(docs, labels.limit(0)))
    assert unmarked == plain_audit([r[:3] for r in rows], [])


def test_other_numbers_of_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 0, 1), ("p", 2, 4, 1, 1), ("q", 1, 7, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.part, r.filter_order, r.step): r for r in A.audit_orders(cells, "AB").collect()}
    assert len(got) == 8
    assert got["p", "BA", 1].removed == 6 and got["p", "BA", 2].removed == 0 and got["p", "BA", 2].redundant == 2 and got["p", "BA", 2].kept == 5
    assert got["p", "AB", 2].unique_fails == 4 and got["p", "AB", 2].shapley == 10 and got["q", "AB", 1].shapley == 14
    assert A.audit_orders(cells, "ABCDEF").count() == 2 * 720 * 6


def test_the_session_keeps_its_bound_of_rows(spark, make_docs):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "77")
    try:
        docs = make_docs([(i, f"text {i}", f"l{i}", "a") for i in range(40)])
        labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        assert A.filter_audit(docs, labels).count() == 40 * 600
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "77"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_same_as_sql(spark):
    from innkeep.oracle.compare import compare, duck_connect
    ok, why = compare(queries.QUERIES["op11_filter_audit"](spark, SF), queries.ORACLE["op11_filter_audit"], duck_connect(SF))
    assert ok, why
