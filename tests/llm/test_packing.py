import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from innkeep.llm import packing, tokenizing

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def slow():
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: tok.encode(t, add_special_tokens=False).ids


def check(docs, slow, max_length=2048):
    rows = docs.select("doc_id", "text").collect()
    got = packing.pack(docs, max_length=max_length).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    by_length = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by_length] == sorted((r.length for r in got), reverse=True)
    assert all(r.offset == 0 and r.length <= max_length and r.length & (r.length - 1) == 0 for r in got)
    want = []
    for r in rows:
        ids = [*slow(r.text or ""), 1]
        start = 0
        for n in packing.binary_lengths(len(ids), max_length):
            want.append((r.doc_id, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes()), len(ids)))
            start += n
        assert start == len(ids)
    assert sorted(want, key=str) == sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str)


def test_round_trip_on_documents(spark, slow):
    check(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 4 = 0"), slow)


def test_edge_cases(make_docs, slow):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "x", "en", "a"), (3, "x", "en", "a"), (None, "no id", "en", "a"),
            (4, "word " * 30_000, "en", "a"), (5, "a" * 100_000, "en", "a"), (6, "<|endoftext|> 漢字 \U0001F600 ﷺ", "x", None)]
    docs = make_docs(rows).withColumn("start", F.lit("clash")).withColumn("bucket", F.lit(1))
    check(docs, slow)
    check(docs.filter("doc_id < 4"), slow, max_length=1)
    assert packing.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(docs, max_length=1000)


def test_binary_lengths():
    for n in (1, 2, 2047, 2048, 2049, 10_000):
        cut = packing.binary_lengths(n)
        assert sum(cut) == n and len(set(cut)) == len([c for c in cut if c < 2048]) + (2048 in cut)


def test_both_libraries_agree_where_the_fast_one_is_used(slow):
    rng = random.Random(3)
    chars = [chr(c) for c in [*range(0, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]]
    for _ in range(3000):
        t = "".join(rng.choice(chars) for _ in range(rng.randint(0, 50)))
        assert tokenizing.COMMON.search(t) is None
        assert tokenizing.token_ids(t) == slow(t)


def test_added_tokens_and_very_long_runs(slow):
    assert tokenizing.token_ids("hello <|endoftext|> world") == slow("hello <|endoftext|> world") == [31373, 220, 50256, 995]
    n = tokenizing.LONG_RUN
    runs = [" " * n, "\n" * (n + 1), "\t \r\n\x0b\x0c\xa0" * n, "\x85" * n]
    texts = [f"{a}{run}{b}" for run in runs for a in ("", "one", "it's ") for b in ("", "two", "!", "\x1c", "7 ")]
    texts += [" " * (n - 1) + "x", f"a{' ' * n}b{chr(10) * n}c", f"<|endoftext|>{' ' * n}", "\x1c" * (n + 5), "é" * n]
    for t in texts:
        assert tokenizing.token_ids(t) == slow(t)


@pytest.mark.parametrize("unit", [" ", "\n", "a", "!", "1"])
def test_five_million_of_one_character(unit, slow):
    text = "start " + unit * 5_000_000 + " end"
    assert tokenizing.token_ids(text) == slow(text)
    assert len(tokenizing.token_ids(text, "byte_bpe_multi_50k.tiktoken")) > 1000


def test_one_such_text_does_not_end_a_job(make_docs, slow):
    rows = [(1, " " * 1_200_000, "en", "a"), (2, "x <|endoftext|> y", "en", "a"), (3, "\n" * 1_000_000 + "w", "en", "a")]
    check(make_docs(rows), slow)
