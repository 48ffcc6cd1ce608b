"""Rules-as-columns: each validation rule is a boolean Column plus a message.

A request (or item) row gets ``errors``: the messages of every failing rule
in schema order, like ``validation.error.issues.map(e => e.message)``.  All
work is column expressions inside whole-stage codegen; no per-row Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from innkeep.functions.text import js_len, js_trim

# The number rule's pattern and the validator library's default
# messages (custom messages of the schemas are passed in by the callers).
MONEY_RE = r"^[0-9]+(\.[0-9]{1,2})?\z"   # the pattern ^\d+(\.\d{1,2})?$; in Java regex, $ would
                                         # also match before a final newline, so end of input is \z
MSG_MISSING_STRING = "Invalid input: expected string, received undefined"
MSG_INVALID_INPUT = "Invalid input"


def msg_too_small(n: int) -> str:
    return f"Too small: expected string to have >={n} characters"


def msg_too_big(n: int) -> str:
    return f"Too big: expected string to have <={n} characters"


def msg_enum(values: Sequence[str]) -> str:
    return "Invalid option: expected one of " + "|".join(f'"{v}"' for v in values)


class Rule(NamedTuple):
    ok: Column          # TRUE when the value passes; NULL counts as failing
    message: str | Column


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_ok(c: str | Column) -> Column:
    """``/^\\d+(\\.\\d{1,2})?$/`` on the string form of the value."""
    return _c(c).rlike(MONEY_RE)


def parse_date(c: str | Column) -> Column:
    """``Date.parse`` validity, narrowed to ISO dates/timestamps: the parsed
    DATE, or NULL when the text is not a date."""
    return js_trim(_c(c)).try_cast("date")


def parse_instant(c: str | Column) -> Column:
    """The instant a date or timestamp text names (a date alone: its start)."""
    return js_trim(_c(c)).try_cast("timestamp_ntz")


def errors(rules: Sequence[Rule]) -> Column:
    """ARRAY<STRING> of the messages of failing rules, in rule order.

    Joined from one small array per rule instead of filtered by a lambda: a
    lambda, and all it is applied to, is interpreted row by row."""
    empty = F.array().cast("array<string>")
    if not rules:
        return empty
    msgs = [r.message if isinstance(r.message, Column) else F.lit(r.message) for r in rules]
    return F.concat(*[F.when(~F.coalesce(r.ok, F.lit(False)) & m.isNotNull(), F.array(m)).otherwise(empty) for r, m in zip(rules, msgs)])


# -- rule builders -------------------------------------------------------------
def string_rules(c: str | Column, min_len: int | None = None, max_len: int | None = None,
                 min_msg: str | None = None, max_msg: str | None = None,
                 required: bool = True) -> list[Rule]:
    """A (sanitized, so already trimmed) string field with length bounds.
    Missing + required -> type error only; missing + optional -> passes."""
    col = _c(c)
    rules = []
    if required:
        rules.append(Rule(col.isNotNull(), MSG_MISSING_STRING))
    absent = col.isNull()
    if min_len is not None:
        rules.append(Rule(absent | (js_len(col) >= min_len), min_msg or msg_too_small(min_len)))
    if max_len is not None:
        rules.append(Rule(absent | (js_len(col) <= max_len), max_msg or msg_too_big(max_len)))
    return rules


def money_rules(c: str | Column, field: str, required: bool = True) -> list[Rule]:
    """digitsOnly(field): a non-empty string matching the number pattern; the
    empty string passes only when optional."""
    col = _c(c)
    msg = f"{field} is required and should be a number"
    ok = F.when(col.isNull(), F.lit(False)).when(col == "", F.lit(not required)).otherwise(money_ok(col))
    return [Rule(ok, F.when(col.isNull(), F.lit(MSG_INVALID_INPUT)).otherwise(F.lit(msg)))]


def enum_rules(c: str | Column, values: Sequence[str], default: str | None = None) -> list[Rule]:
    """``z.enum(values)``, optionally ``.default(default)`` for a missing value."""
    col = _c(c)
    ok = col.isin(*values)
    if default is not None:
        ok = col.isNull() | ok
    return [Rule(ok, msg_enum(values))]


def date_rules(c: str | Column, message: str) -> list[Rule]:
    col = _c(c)
    return [Rule(col.isNotNull(), MSG_MISSING_STRING),
            Rule(col.isNull() | parse_date(col).isNotNull(), message)]


def as_number(c: str | Column) -> Column:
    """``Number(s)`` for strings that passed the number rule."""
    return _c(c).try_cast("double")


def with_default(c: str | Column, value) -> Column:
    return F.coalesce(_c(c), F.lit(value))
