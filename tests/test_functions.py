"""Scalar helpers against plain-Python definitions of the semantics they
reproduce, on random and edge-case inputs."""

import random
import re

from pyspark.sql import functions as F

from innkeep.functions.ids import digits_number, pad5, unsigned_suffix
from innkeep.functions.rules import money_ok
from innkeep.functions.text import js_len, js_trim

JS_WS = " \t\n\r\x0b\x0c         　﻿"


def _strings(n=400, seed=9):
    rnd = random.Random(seed)
    alphabet = "0123456789.-aBX _" + JS_WS
    out = ["", "0", "00.1", "1.", ".5", "12.345", "12.34", "١٢", "BR123-4", "  7 ", "REV", "x "]
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 8))) for _ in range(n)]
    return out


def _eval(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_money_rule_matches_regex(spark):
    vals = _strings()
    got = _eval(spark, vals, money_ok)
    want = [re.fullmatch(r"[0-9]+(\.[0-9]{1,2})?", v) is not None for v in vals]
    assert got == want


def test_js_trim_and_length(spark):
    vals = _strings() + ["a\U0001F600b"]
    assert _eval(spark, vals, js_trim) == [v.strip(JS_WS) for v in vals]
    assert _eval(spark, vals, js_len) == [len(v.encode("utf-16-le")) // 2 for v in vals]


def test_digits_and_unsigned_suffix(spark):
    vals = _strings()
    want_digits = [int("".join(c for c in v if c in "0123456789") or "0") for v in vals]
    assert _eval(spark, vals, digits_number) == want_digits

    def mysql_unsigned(v, start):
        m = re.match(r"[ \t\n\x0b\x0c\r]*([0-9]+)", v[start - 1:])   # ASCII whitespace only
        return int(m.group(1)) if m else 0
    assert _eval(spark, vals, lambda c: unsigned_suffix(c, 3)) == [mysql_unsigned(v, 3) for v in vals]


def test_pad5_never_truncates(spark):
    nums = [0, 1, 42, 99999, 100000, 1234567]
    assert _eval(spark, nums, lambda c: pad5("HOT", c), "long") == ["HOT" + str(n).zfill(5) for n in nums]
