"""Language of whole texts: averaged hashed subword embeddings and a linear
softmax.

Subwords are all runs of three and four bytes of the lower-cased text in which
every run of other characters than letters counts as one space; each has a row
of an embedding table by its hash.  A text is the average of its subwords'
embeddings; a linear layer and a softmax give the languages' probabilities.
Both layers are trained by stochastic gradient descent on the driver on a
bounded sample of labelled rows.  A part of the sample is kept aside to
calibrate: a temperature makes the probabilities honest there, and a text is
rejected if its probability lies below what all but ``REJECT`` of the rightly
recognised texts reach.  A sample under 100 texts is too small for that: nothing
is calibrated, and no text with a letter is rejected.

Defined results: a null text, or one without a letter, is ``und`` with score
0 and is rejected; repeated rows have equal results; a null doc_id counts as
not held out; a text whose letters are too few for a subword has the prior's
result; if no language can be learned all are ``und``; an empty table gives no
rows; further columns are kept by ``identified`` whatever their names (the
new ones then get underscores)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from innkeep.llm.common import append_columns, arrow_schema_with, free_name, held_out, row_slices, text_buffer
from innkeep.llm.textscan import LETTER, LOWER

ROWS, DIM = 1 << 13, 16
TRAIN_ROWS = 800         # labelled rows of each language at most,
TRAIN_ALL = 4000         # and of all together, shared evenly, but one of each language at least
TRAIN_TEXT = 20_000      # bytes; longer texts are left out of the sample where a language has shorter ones
REJECT = 0.002
UNKNOWN = "und"
_SLICE = 200_000
_HASHES = 1 << 40


def subword_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[text, row]: how often each hashed subword occurs."""
    n = len(offsets) - 1
    letter = LETTER[data]
    low = np.where(letter, LOWER[data], 0x20).astype(np.uint8)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    keep = letter.copy()                                     # of a run of other bytes only the first stays
    keep[1:] |= letter[:-1] & ~letter[1:]
    keep[edge[:-1]] = True
    low = low[keep].astype(np.uint32)
    text = np.repeat(np.arange(n), np.diff(offsets))[keep]
    counts = np.zeros(n * ROWS, np.int64)
    for width in (3, 4):
        if len(low) < width:
            continue
        h = np.full(len(low) - width + 1, np.uint32(2166136261 + width))
        for j in range(width):
            h = (h ^ low[j:j + len(h)]) * np.uint32(16777619)
        inside = text[width - 1:] == text[:len(h)]
        at = text[:len(h)] * ROWS + ((h ^ (h >> np.uint32(15))) % np.uint32(ROWS))
        counts += np.bincount(at[inside], minlength=n * ROWS)
    return counts.reshape(n, ROWS)


def _averages(counts: np.ndarray) -> np.ndarray:
    return (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


@dataclass
class Recogniser:
    languages: list[str]
    layers: list[np.ndarray] # embeddings and linear layer, multiplied where that is smaller
    bias: np.ndarray
    temperature: float
    least: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        x = _averages(counts)
        for layer in self.layers:
            x = x @ layer
        return _softmax((x + self.bias) / self.temperature)


def train(x: np.ndarray, label: np.ndarray, languages: list[str], epochs: int = 12, batch: int = 32,
          rate: float = 0.5, seed: int = 0) -> Recogniser:
    """``x``: a row of subword averages for each text; it is scaled in place."""
    rng, many = np.random.default_rng(seed), len(languages)
    x *= 100                                                 # averages are small; the scale is undone in the table
    order = rng.permutation(len(x))
    one = np.zeros(len(x), bool)                             # a text of each language is never kept aside
    one[np.unique(label[order], return_index=True)[1]] = True
    aside = order[~one][:len(x) // 5]
    used = np.concatenate([order[~one][len(x) // 5:], order[one]])
    used = used[rng.permutation(len(used))]
    embed = rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32)
    linear, bias = rng.normal(0, 0.1, (DIM, many)).astype(np.float32), np.zeros(many, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for lo in range(0, len(used), batch):
            rows = used[lo:lo + batch]
            hidden = x[rows] @ embed
            wrong = _softmax(hidden @ linear + bias)
            wrong[np.arange(len(rows)), label[rows]] -= 1
            wrong /= len(rows)
            back = wrong @ linear.T
            linear -= step * (hidden.T @ wrong)
            bias -= step * wrong.sum(axis=0)
            embed -= step * (x[rows].T @ back)
    layers = [100 * embed @ linear] if many <= DIM else [100 * embed, linear]
    found = Recogniser(languages, [layer.astype(np.float32) for layer in layers], bias, 1.0, 0.0)
    if len(aside) >= 20:
        logits, y = x[aside] @ embed @ linear + bias, label[aside]
        grid = np.geomspace(0.25, 8, 31)
        loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-9).mean() for t in grid]
        found.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(logits / found.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        if len(right):
            found.least = float(np.quantile(right, REJECT))
    return found


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS, text_bytes: int = TRAIN_TEXT,
                    in_all: int = TRAIN_ALL) -> list[tuple[str, str]]:
    """(text, lang) of every language that has texts not held out: each has up
    to its even share of ``in_all`` texts, ``rows`` at most and one at least.
    Twice the share is drawn, by their hashes, as some may be copies.  Texts
    over ``text_bytes`` are taken, whole, for languages without shorter ones,
    as many as have the bytes of a share of shorter ones."""
    size = F.octet_length("text")
    usable = (docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (size >= 1))
              .select("lang", (size > text_bytes).alias("long"),
                      F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(_HASHES)).alias("spot"), "text"))
    many = (usable.groupBy("lang", "long").agg(F.count(F.lit(1)).alias("n"), F.min("spot").alias("first"), F.avg(F.octet_length("text")).alias("bytes"))
            .groupBy("lang").agg(F.min(F.struct("long", "n", "first", "bytes")).alias("g")).select("lang", "g.*"))
    languages = many.select(F.count(F.lit(1))).scalar()
    share = F.least(F.lit(rows), F.greatest(F.lit(1), F.floor(F.lit(in_all) / languages)))
    share = F.when(F.col("long"), F.least(share, F.greatest(F.lit(1), F.floor(share * text_bytes / F.col("bytes"))))).otherwise(share)
    below = many.select("lang", "long", F.greatest(F.ceil(F.lit(2.0 * _HASHES) * share / F.col("n")), F.col("first") + 1).alias("below"))
    found = (usable.join(F.broadcast(below), ["lang", "long"])                # one row a language
             .filter("spot < below").select("lang", "spot", "text").distinct().collect())
    most = min(rows, max(1, in_all // max(1, len({r["lang"] for r in found}))))
    taken: dict[str, list[str]] = {}
    spent: dict[str, int] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["spot"], r["text"])):
        texts, have = taken.setdefault(r["lang"], []), spent.get(r["lang"], 0)
        more = len(r["text"].encode())
        if not texts or len(texts) < most and have + more <= most * text_bytes:
            texts.append(r["text"])
            spent[r["lang"]] = have + more
    return [(text, lang) for lang, texts in taken.items() for text in texts]


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Recogniser | None:
    sample = training_sample(docs, rows)
    languages = sorted({lang for _, lang in sample})
    if not languages:
        return None
    data, offsets = text_buffer(pa.array([t for t, _ in sample], pa.large_string()))
    number = {lang: i for i, lang in enumerate(languages)}
    x = np.empty((len(sample), ROWS), np.float32)
    for a, b in row_slices(offsets, _SLICE):
        x[a:b] = _averages(subword_counts(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))
    return train(x, np.array([number[lang] for _, lang in sample]), languages)


def recognise(model: Recogniser | None, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    n = len(offsets) - 1
    if model is None:
        return [UNKNOWN] * n, np.zeros(n)
    names, scores = [], []
    for lo in range(0, n, 500):                              # rows of counts held at once
        hi = min(n, lo + 500)
        p = model.probabilities(subword_counts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]))
        names += [model.languages[i] for i in p.argmax(axis=1)]
        scores.append(p.max(axis=1).astype(np.float64))
    return names, np.concatenate(scores) if scores else np.zeros(0)


def identified(docs: DataFrame, model: Recogniser | None) -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` with lang_pred, score and accepted, and these columns' names."""
    pred, score, accepted = (free_name(c, docs.columns) for c in ("lang_pred", "score", "accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM numbers at most for each of ROWS subwords, and for each language
    spot = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(spot))
            for lo, hi in row_slices(offsets, _SLICE):
                names, p = recognise(shared.value, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                yield append_columns(batch.slice(lo, hi - lo), {pred: pa.array(names, pa.string()), score: pa.array(p, pa.float64())})

    out = docs.mapInArrow(run, arrow_schema_with(docs, **{pred: T.StringType(), score: T.DoubleType()}))
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & (F.col(pred) != UNKNOWN)
    out = out.withColumn(score, F.when(known, F.col(score)).otherwise(0.0)).withColumn(pred, F.when(known, F.col(pred)).otherwise(UNKNOWN))
    least = model.least if model is not None else 0.0
    return out.withColumn(accepted, (F.col(pred) != UNKNOWN) & (F.col(score) >= least)), (pred, score, accepted)


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out, (pred, score, accepted) = identified(rows, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(pred).alias("lang_pred"),
                      F.col(score).alias("score"), F.col(accepted).alias("accepted"))


def recognised_only(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is accepted."""
    out, (pred, score, accepted) = identified(docs, fit(docs))
    return out.filter(F.col(accepted)).select(*docs.columns)
