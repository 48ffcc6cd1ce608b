"""Spelling variants by dense prefix-suffix tiles.

Words whose longer one has m code points differ by one inserted, deleted or
replaced code point exactly if their common prefix and common suffix together
reach m - 1.  Words are laid out as matrices of code points, padded on the
right for prefixes and on the left for suffixes, and blocks of words are
compared with blocks, all with all, in one numpy operation.

One of the two common ends then has at least m // 2 code points.  So blocks
are only made of words that share that many at the start, or at the end: each
word is in four groups (start or end, m its own length or one more), which no
pair can miss.  A pair found by its start is left out of the tiles by the end,
so it counts once.  A group of over ``TILE`` words is cut into chunks by hash,
and each pair of chunks is a tile of its own; a tile returns one row a word
(number of near words, the most frequent of them), never pairs.

Counts are gathered in the tasks before they are shuffled, so a word as
frequent as a third of the corpus is a few rows.

Defined results: a null text has no words; a null doc_id enters the hash as
empty text; repeated rows count each; among near words of equal counts the
first by code points is taken; a word without near words, or without one five
times as frequent, is its own root; an empty table gives no rows; further
columns of the input, whatever their names, are not carried.  Texts and runs
are never cut, however long."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm.common import materialize

RUN = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5                  # a form is that many times as frequent
SLIP = 199                 # one run of a document in so many loses a code point
TILE = 1024                # words of a group compared in one block
_TILE_CHARS = 1 << 18      # code points of a block of long words
_AT_ONCE = 1 << 22         # code points compared in one numpy operation
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HELD = 200_000            # words, and _HELD_CHARS code points, counted before they are passed on
_HELD_CHARS = 8_000_000


# --- words ------------------------------------------------------------------

def text_words(doc_id: int | None, text: str, least: int = LEAST_LENGTH) -> Counter:
    """Counts of a text's words of at least ``least`` code points."""
    low = text.encode().translate(_LOWER).decode()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(re.findall(f"{RUN}{{{least},}}", low)).items():
        h = zlib.crc32(run.encode(), start)
        if h % SLIP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word of the result occurs in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        chars = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                found = text_words(ids[i], text)
                chars += sum(len(w) for w in found if w not in held)
                held.update(found)
                if len(held) >= _HELD or chars >= _HELD_CHARS:
                    yield _counted(held)
                    held, chars = Counter(), 0
        yield _counted(held)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


# --- tiles ------------------------------------------------------------------

def code_points(words: list[str], width: int, right: bool = False) -> np.ndarray:
    """Words as rows of code points, padded by zeros to ``width`` (on the left
    if ``right``)."""
    out = np.zeros((len(words), width), np.uint32)
    for i, w in enumerate(words):
        row = np.frombuffer(w.encode("utf-32-le"), "<u4")
        out[i, width - len(row) if right else 0:width if right else len(row)] = row
    return out


def common_starts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every row of ``a`` and of ``b`` the length of their common start."""
    same = a[:, None, :] == b[None, :, :]
    return np.where(same.all(axis=2), a.shape[1], same.argmin(axis=2))


def near_in_tile(long: list[str], other: list[str], m: int, by_end: bool) -> np.ndarray:
    """Which of ``long`` (m code points) and ``other`` (m or m - 1) are one edit
    apart; by the end only those whose common start is shorter than m // 2."""
    out = np.zeros((len(long), len(other)), bool)
    la, ra = code_points(long, m), code_points(long, m, True)[:, ::-1]
    lb, rb = code_points(other, m), code_points(other, m, True)[:, ::-1]
    rows = max(1, _AT_ONCE // max(1, m * len(other)))
    cols = max(1, _AT_ONCE // m)
    for i in range(0, len(long), rows):
        for j in range(0, len(other), cols):
            p, s = common_starts(la[i:i + rows], lb[j:j + cols]), common_starts(ra[i:i + rows], rb[j:j + cols])
            near = (p + s >= m - 1) & (p < m)                # p = m: the word itself
            if by_end:
                near &= p < m // 2
            out[i:i + rows, j:j + cols] = near
    return out


def _tile_rows(words: list[str], n: np.ndarray, chunk: np.ndarray, m: int, by_end: bool, a: int, b: int) -> tuple[list[str], list[int], list[str], list[int]]:
    """(word, near words, most frequent near word, its count) of a tile.  Chunk
    a meets chunk b; if they are one chunk, it meets itself."""
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))    # the best near word comes first
    words, n, chunk = [words[i] for i in order], n[order], chunk[order]
    length = np.array([len(w) for w in words])
    left, right = np.flatnonzero(chunk == a), np.flatnonzero(chunk == b)
    meets = []
    for x, y in ((left, right),) if a == b else ((left, right), (right, left)):
        x = x[length[x] == m]
        if a != b and meets:                                              # equal lengths have met already
            y = y[length[y] == m - 1]
        if len(x) and len(y):
            meets.append((x, y, near_in_tile([words[i] for i in x], [words[i] for i in y], m, by_end)))
    many, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    for x, y, near in meets:
        many[x] += near.sum(axis=1)
        best[x] = np.minimum(best[x], np.where(near.any(axis=1), y[near.argmax(axis=1)], len(words)))
        back = near if a != b else near & (length[y] == m - 1)            # within a chunk equal lengths are in both rows
        many[y] += back.sum(axis=0)
        best[y] = np.minimum(best[y], np.where(back.any(axis=0), x[back.argmax(axis=0)], len(words)))
    has = np.flatnonzero(many)
    return [words[i] for i in has], many[has].tolist(), [words[i] for i in best[has]], n[best[has]].tolist()


def _tiles_of_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles arrive whole and in order; the last one of a batch may go on in the next."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    out: tuple[list, list, list, list] = ([], [], [], [])
    for (by_end, m, _, a, b), tile in itertools.groupby(rows, key=lambda r: r[:5]):
        tile = list(tile)
        if len(tile) > 1:
            found = _tile_rows([r[5] for r in tile], np.array([r[6] for r in tile]), np.array([r[7] for r in tile]), m, by_end, a, b)
            for held, new in zip(out, found):
                held += new
        if len(out[0]) > 50_000:
            yield _near(out)
            out = ([], [], [], [])
    yield _near(out)


def _near(out: tuple[list, list, list, list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["word", "near", "best", "best_n"])


def near_words(vocabulary: DataFrame, tile: int = TILE) -> DataFrame:
    """word, n_near, best, best_n of every word that has near words:
    ``vocabulary`` is a table read back (word, n), words being unique."""
    m = F.col("length")
    key: list[Column] = []
    for by_end, more in itertools.product((False, True), (0, 1)):
        k = F.floor((m + more) / 2).cast("int")
        key.append(F.struct(F.lit(by_end).alias("by_end"), (m + more).alias("m"),
                            (F.right("word", k) if by_end else F.left("word", k)).alias("part")))
    keyed = vocabulary.withColumn("length", F.length("word")).select("word", "n", "length", F.explode(F.array(*key)).alias("k")).select("word", "n", "length", "k.*")
    group = ["by_end", "m", "part"]
    size = F.least(F.lit(tile), F.greatest(F.lit(1), F.floor(F.lit(_TILE_CHARS) / F.col("m"))))
    shared = materialize(keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("many"), F.count_if(F.col("length") == F.col("m")).alias("long"))
                         .filter("many > 1 and long > 0").select(*group, F.ceil(F.col("many") / size).cast("int").alias("chunks")))
    cut = (keyed.join(shared, group).withColumn("own", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
           .select(*group, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "word", "n", F.col("own").alias("chunk")))
    keys = [*group, "a", "b"]
    found = cut.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_tiles_of_sorted, "word string, near long, best string, best_n long")
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b"))
            .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n")))


# --- forms and roots --------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of ``forms`` (word, form): forms followed to
    the last.  Counts grow from form to form, so there are no cycles, and each
    round doubles the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if not after.filter("moved").head(1):
            return now


def spelling_groups(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    vocabulary = materialize(word_counts(docs))
    near = materialize(near_words(vocabulary, tile))
    known = materialize(vocabulary.join(near, "word", "left").withColumn("own", F.col("best_n") >= TIMES * F.col("n"))
                        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(F.col("own"), F.col("best")).alias("form"), F.when(F.col("own"), F.col("best_n")).alias("form_n")))
    last = roots(known.filter("form is not null"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
