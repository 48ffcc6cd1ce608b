"""String helpers with JavaScript semantics where the reference relies on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters String.prototype.trim removes (ECMAScript
# WhiteSpace and LineTerminator), as a Java regex class.
JS_SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c: str | Column) -> Column:
    """``s.trim()``: strips all JS whitespace, not only spaces."""
    return F.regexp_replace(_c(c), f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def js_len(c: str | Column) -> Column:
    """``s.length`` counts UTF-16 code units (a character outside the BMP
    counts twice), unlike Spark's ``length`` (code points): half the UTF-16
    byte length."""
    return (F.length(F.encode(_c(c), "UTF-16LE")) / 2).cast("int")


def empty_to_null(c: str | Column) -> Column:
    """``value || null`` for strings: '' becomes NULL."""
    return F.nullif(_c(c), F.lit(""))
