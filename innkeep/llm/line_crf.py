"""Document quality by line sequence labelling.

Every line with a word is described by what its characters are (capitals,
symbols, digits, length, whether it repeats).  A linear-chain conditional
random field labels a text's lines as content or boilerplate; Viterbi decoding
finds the best sequence, and the share of words in content lines decides
whether the text is kept.

The field is trained in numpy on a bounded sample of labelled texts (``ROWS``
of each class at most, not held out, the base condition held).  Labels are of texts, not of lines: the
lines of good texts are content throughout; those of poor texts start as
boilerplate, and after each round of training are decoded anew, the most
boilerplate-like line of each staying so.

Before it, plain counts of the whole text decide the base condition: too few
words, or too many of them in repeated windows of three.

Defined results: a null text is empty; a text without words fails the base
condition and has a content share of 0; without labelled texts of both classes
to learn from every line is content; repeated rows have equal results; a null
doc_id is kept as it is; an empty table gives no rows; further columns,
whatever their names, are not carried.  Texts are never cut, however long."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import row_slices, text_buffer
from innkeep.llm.textscan import words
from innkeep.llm.toxicity import training_sample

ROWS = 600               # labelled texts of each class at most
LEAST_WORDS = 50
MOST_REPEATED = 50       # percent of the words
LEAST_CONTENT = 0.5      # share of the words
BOILERPLATE, CONTENT = 0, 1
_SPACE = b" \t\n\x0b\f\r"
_SYMBOLS = b"#*$%&|<>"
_SLICE = 400_000         # bytes of text worked on at once

# kinds of bytes that lines are described by
_OTHER, _CAPITAL, _LETTER, _DIGIT, _BLANK, _STOP, _SHOUT, _MARK, _BAR = range(9)
_KIND = np.full(256, _OTHER, np.int64)
_KIND[ord("a"):ord("z") + 1] = _LETTER
_KIND[0x80:] = _LETTER
_KIND[ord("A"):ord("Z") + 1] = _CAPITAL
_KIND[ord("0"):ord("9") + 1] = _DIGIT
_KIND[list(_SPACE)] = _BLANK
_KIND[list(b".,;:?'\"()-")] = _STOP
_KIND[ord("!")] = _SHOUT
_KIND[list(b"#*$%&<>@{}[]=_/\\")] = _MARK
_KIND[ord("|")] = _BAR
FEATURES = ("always", "capitals", "marks", "shouts", "bars", "digits", "stops", "words", "word length", "repeated")


# --- counts of a text -------------------------------------------------------

def repeated_words(tokens: list[bytes]) -> int:
    """How many words are in windows of three that occur twice or more."""
    n = len(tokens)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    one = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, n)
    pair = np.unique(one[:-1] * len(number) + one[1:], return_inverse=True)[1]
    _, three, many = np.unique(pair[:-1] * len(number) + one[2:], return_inverse=True, return_counts=True)
    twice = many[three] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k:n - 2 + k] |= twice
    return int(inside.sum())


def text_counts(raw: bytes) -> tuple[tuple[int, int, int, int, int], list[bool]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text
    in UTF-8, and for each line with a word whether it equals an earlier one."""
    tokens, seen, dup = raw.split(), set(), []
    for line in raw.split(b"\n"):
        if line.strip():
            dup.append(line in seen)
            seen.add(line)
    kept = np.frombuffer(raw.translate(None, _SPACE), np.uint8)
    chars = int(((kept & 0xC0) != 0x80).sum())               # bytes that start a code point
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return (len(tokens), chars, symbols, sum(dup), repeated_words(tokens)), dup


def base_failed(n_words, n_repeat_words):
    """The base condition, on numbers or columns."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


# --- lines ------------------------------------------------------------------

def line_features(data: np.ndarray, offsets: np.ndarray, dup: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, words, first): a row for each line with a word; text i has
    the lines ``first[i]:first[i+1]``.  ``dup`` is given per such line."""
    cut = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 0x0A) + 1]))
    cut = cut[cut < len(data)]
    start, _, _ = words(data, offsets)
    n_lines = len(cut)
    if not n_lines or not len(start):
        return np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    line_of = np.repeat(np.arange(n_lines), np.diff(np.append(cut, len(data))))
    kinds = np.bincount(line_of * 9 + _KIND[data], minlength=n_lines * 9).reshape(n_lines, 9)
    n_words = np.bincount(line_of[start], minlength=n_lines)
    has = n_words > 0
    kinds, n_words, begin = kinds[has].astype(float), n_words[has], cut[has]
    first = np.searchsorted(begin, offsets)
    chars = kinds.sum(axis=1) - kinds[:, _BLANK]
    letters = np.maximum(1, kinds[:, _CAPITAL] + kinds[:, _LETTER])
    a_word = lambda kind: np.minimum(1, kinds[:, kind] / n_words)
    x = np.column_stack([np.ones(len(begin)), kinds[:, _CAPITAL] / letters, a_word(_MARK), a_word(_SHOUT), a_word(_BAR),
                         kinds[:, _DIGIT] / chars, a_word(_STOP), np.minimum(1, np.log1p(n_words) / 6),
                         np.minimum(2, chars / n_words / 8), dup.astype(float)])
    return x, n_words, first


# --- the field --------------------------------------------------------------

@dataclass(frozen=True)
class LineField:
    """Scores of a line's labels (features x 2), of neighbouring labels (2 x 2)
    and of the first label (2)."""
    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray


def _padded(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences sorted by length, longest first: (order, lengths, line index by
    place and sequence); only the first sequences reach a late place."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    return order, length[order], first[order]


def viterbi(field: LineField, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of every line, each text being a sequence."""
    emit = x @ field.emit
    order, length, at = _padded(x, first)
    label = np.zeros(len(x), np.int64)
    if not len(order):
        return label
    reach = np.searchsorted(-length, -np.arange(length[0]), "left")       # sequences longer than each place
    back = np.zeros((len(x), 2), np.int8)
    best = emit[at] + field.start
    last = np.empty((len(order), 2))
    for t in range(1, length[0]):
        n = reach[t]
        last[n:len(best)] = best[n:]
        paths = best[:n, :, None] + field.step                           # sequence, label before, label
        back[at[:n] + t] = paths.argmax(axis=1)
        best = paths.max(axis=1) + emit[at[:n] + t]
    last[:len(best)] = best
    now = np.empty(len(order), np.int64)
    for t in range(length[0] - 1, -1, -1):
        n, more = reach[t], reach[t + 1] if t + 1 < length[0] else 0
        now[more:n] = last[more:n].argmax(axis=1)                        # these end here
        label[at[:n] + t] = now[:n]
        if t:
            now[:n] = back[at[:n] + t, now[:n]]
    return label


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def log_likelihood(field: LineField, x: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, LineField]:
    """Of the given labels, and its gradient, by the forward and backward sums.
    ``weight`` has the weight of its text for every line."""
    emit = x @ field.emit
    order, length, at = _padded(x, first)
    reach = np.searchsorted(-length, -np.arange(length[0]), "left")
    ahead, behind = np.zeros((len(x), 2)), np.zeros((len(x), 2))
    ahead[at] = emit[at] + field.start
    for t in range(1, length[0]):
        here = at[:reach[t]] + t
        ahead[here] = _log_sum(ahead[here - 1][:, :, None] + field.step, 1) + emit[here]
    for t in range(length[0] - 2, -1, -1):
        here = at[:reach[t + 1]] + t
        behind[here] = _log_sum(field.step + (emit[here + 1] + behind[here + 1])[:, None, :], 2)
    whole = np.empty(len(x))
    whole[:] = np.repeat(_log_sum(ahead[first[1:][np.diff(first) > 0] - 1], 1), np.diff(first)[np.diff(first) > 0])
    p = np.exp(ahead + behind - whole[:, None])
    is_first = np.zeros(len(x), bool)
    is_first[at] = True
    second = np.flatnonzero(~is_first)
    pairs = np.exp(ahead[second - 1][:, :, None] + field.step + (emit[second] + behind[second])[:, None, :] - whole[second][:, None, None])
    truth = np.eye(2)[label]
    wrong = weight[:, None] * (truth - p)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[second - 1], label[second]), weight[second])
    value = ((weight[:, None] * emit * truth).sum() + (weight[at] * (field.start[label[at]] - whole[at])).sum()
             + (weight[second] * field.step[label[second - 1], label[second]]).sum())
    return float(value), LineField(x.T @ wrong, seen - np.tensordot(weight[second], pairs, 1), wrong[at].sum(axis=0))


def train(x: np.ndarray, first: np.ndarray, good: np.ndarray, rounds: int = 4, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> LineField:
    """``good`` tells each text's label.  Adam on the mean log likelihood, good
    and poor lines having equal weight together."""
    length = np.diff(first)
    of = np.repeat(np.arange(len(good)), length)
    label = good[of].astype(np.int64)
    weight = np.where(good[of], len(x) / (2 * good[of].sum()), len(x) / (2 * (~good[of]).sum()))
    size = [(len(FEATURES), 2), (2, 2), (2,)]
    w = [np.zeros(s) for s in size]
    for _ in range(rounds):
        mean, square = [np.zeros(s) for s in size], [np.zeros(s) for s in size]
        for k in range(1, steps + 1):
            _, grad = log_likelihood(LineField(*w), x, first, label, weight)
            for i, g in enumerate((grad.emit, grad.step, grad.start)):
                g = g / len(x) - decay * w[i]
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                w[i] = w[i] + rate * (mean[i] / (1 - 0.9**k)) / (np.sqrt(square[i] / (1 - 0.999**k)) + 1e-8)
        field = LineField(*w)
        poor = ~good[of]
        label = np.where(poor, viterbi(field, x, first), CONTENT)
        doubt = x @ (field.emit[:, BOILERPLATE] - field.emit[:, CONTENT])
        for i in np.flatnonzero(~good & (length > 0)):
            label[first[i] + int(doubt[first[i]:first[i + 1]].argmax())] = BOILERPLATE
    return field


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> LineField | None:
    """The trained field, or None where one class has no texts with words.
    ``labels``: doc_id and quality (1 good, 0 poor)."""
    sample = training_sample(docs, labels.select("doc_id", F.col("quality").alias("toxic")), rows)
    texts, good, dup = [], [], []
    for text, label in sample:
        (n_words, *_, n_repeat), d = text_counts(text.encode())
        if not base_failed(n_words, n_repeat):               # those are decided without the field
            texts.append(text)
            good.append(label == 1)
            dup += d
    good = np.array(good, bool)
    if good.all() or not good.any():
        return None
    data, offsets = text_buffer(pa.array(texts, pa.large_string()))
    x, _, first = line_features(data, offsets, np.array(dup, bool))
    return train(x, first, good)


# --- over tables ------------------------------------------------------------

def _labelled(field: LineField | None, data: np.ndarray, offsets: np.ndarray):
    raw = data.tobytes()
    counts, dup = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        c, d = text_counts(raw[a:b])
        counts.append(c)
        dup += d
    x, n_words, first = line_features(data, offsets, np.array(dup, bool))
    label = viterbi(field, x, first) if field is not None else np.full(len(x), CONTENT)
    return np.array(counts, np.int64).reshape(-1, 5), n_words, first, label


def line_labels(docs: DataFrame, field: LineField | None) -> DataFrame:
    """doc_id, line (number among the text's lines with a word), words, content
    (boolean) of every such line."""
    shared = docs.sparkSession.sparkContext.broadcast(field)   # a few dozen numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_slices(offsets, _SLICE):
                _, n_words, first, label = _labelled(shared.value, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                of = np.repeat(np.arange(hi - lo), np.diff(first))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(of)), pa.array(np.arange(len(of)) - first[:-1][of]),
                     pa.array(n_words.astype(np.int64)), pa.array(label == CONTENT)], names=["doc_id", "line", "words", "content"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, line long, words long, content boolean")


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_quality(docs: DataFrame, field: LineField | None, least_content: float = LEAST_CONTENT) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, content_words and
    content_share of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)   # a few dozen numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in row_slices(offsets, _SLICE):
                counts, n_words, first, label = _labelled(shared.value, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                before = np.concatenate([[0], np.cumsum(n_words * (label == CONTENT))])
                content = (before[first[1:]] - before[first[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(counts[:, k]) for k in range(5)), pa.array(content)],
                                                 names=["doc_id", *_COUNTS, "content_words"])

    schema = ", ".join(f"{c} long" for c in ("doc_id", *_COUNTS, "content_words"))
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
    base = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    share = F.when(F.col("n_words") > 0, F.col("content_words") / F.col("n_words")).otherwise(0.0)
    return out.select("doc_id", *_COUNTS, base.alias("base_failed"), (~base & (share >= least_content)).alias("kept"),
                      "content_words", share.alias("content_share"))


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return line_quality(docs, fit(docs, labels))
