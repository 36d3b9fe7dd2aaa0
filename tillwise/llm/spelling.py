"""Spelling variant grouping by blocked Gram matrices.

The words of a corpus are counted; words one edit apart have letter counts whose squared distance is one or two. Words
are put into cells by length and by how many of their letters fall into each of ``CLASSES`` letter classes. One edit
leaves the length and each class count as they are or moves them by one, so a word can only meet words of its own
cell and of a few next to it. Inside a cell, NumPy products of blocks of letter counts give the squared distances of
all pairs; pairs at most two apart are then compared letter by letter. Each pair of words meets exactly once, and
only its effect on the two words (how many near words, the most frequent one) leaves the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillwise.session import settle

#: Words shorter than this, or met fewer times, are left out.
MIN_LENGTH, MIN_COUNT = 7, 2
#: A form must be so many times as frequent as its variant.
TIMES = 10
#: One run in RARE loses a code point: the noise that the grouping is measured with.
RARE = 31
#: Words of a cell that one task holds; larger cells are cut by a hash of the word.
BLOCK = 4096
CLASSES = 4
#: Numbers of a product worked out at a time.
CELLS = 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a run: a-z once A-Z are lower-cased, and U+00C0 to U+00FF.
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))


def word_counts(docs: DataFrame, rare: int | None = RARE, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of whole texts and how often they occur, counted before the shuffle.

    A run is a longest one of ``LETTERS`` after A-Z are lower-cased. If ``rare`` divides the CRC-32 of
    ``<doc_id>:<run>``, the run's code point at that CRC modulo its length is left out; None leaves all runs
    as they are. A null doc_id is written as nothing, a null text has no runs, rows that repeat count each.
    """
    # Shorter runs give no word. A match of min_length letters or more is a whole run, as the quantifier takes all it can.
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-z\u00C0-\u00FF]{{{min_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    rows = rows.select("id", lower.alias("run"))
    word = F.col("run")
    if rare is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % rare == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    words = rows.select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _class_counts() -> list[Column]:
    """How many letters of a word fall into each class: those whose code point leaves k when divided by CLASSES."""
    return [
        F.length("word") - F.length(F.translate("word", "".join(c for c in LETTERS if ord(c) % CLASSES == k), ""))
        for k in range(CLASSES)
    ]


def _moves() -> list[list[int]]:
    """The cells beside a cell, as changes of its class counts: a letter put in, or one replaced by one of another class.

    Of two opposite changes only one is listed, so that each pair of cells meets once.
    """
    unit = np.eye(CLASSES, dtype=int)
    put_in = [unit[k] for k in range(CLASSES)]
    replaced = [unit[j] - unit[k] for k in range(CLASSES) for j in range(k)]
    return [m.tolist() for m in [*put_in, *replaced]]


class Side:
    """Words with their numbers of occurrences, as letter counts and as rows of letters from the front and the back."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, n
        self.sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        row = np.repeat(np.arange(len(words)), self.sizes)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        longest = int(self.sizes.max(initial=0))
        self.front, self.back = np.zeros((2, len(words), longest), np.uint8)
        self.front[row, at] = codes
        self.back[row, self.sizes[row] - 1 - at] = codes
        # Products are exact: single precision holds all whole numbers below 2^24, double precision those below 2^53.
        self.letters = np.zeros((len(words), 256), np.float32 if longest < 2048 else np.float64)
        np.add.at(self.letters, (row, codes), 1)


def one_edit(left: Side, i: np.ndarray, right: Side, j: np.ndarray) -> np.ndarray:
    """Which pairs of distinct words become equal by exactly one code point inserted, deleted or replaced: what they share
    at the front and at the back leaves one code point of the longer word."""
    a, b = left.sizes[i], right.sizes[j]
    short = np.minimum(a, b)

    def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        width = min(x.shape[1], y.shape[1])
        differ = x[i, :width] != y[j, :width]
        return np.minimum(short, np.where(differ.any(axis=1), differ.argmax(axis=1), width))

    return (np.abs(a - b) <= 1) & (shared(left.front, right.front) + shared(left.back, right.back) >= np.maximum(a, b) - 1)


def near_pairs(left: Side, right: Side) -> Iterator[tuple[int, int]]:
    """Index pairs of words one edit apart, by squared distances of their letter counts, a strip of rows at a time; with
    one side given twice each pair comes once.

    Two columns more make the product itself minus half the squared distance, so it is compared as it comes.
    """
    used = left.letters.any(axis=0) | right.letters.any(axis=0)
    x, y = left.letters[:, used], right.letters[:, used]
    half = [(z * z).sum(axis=1, keepdims=True) / 2 for z in (x, y)]
    one = [np.ones_like(h) for h in half]
    x, y = np.hstack([x, -half[0], one[0]]), np.hstack([y, one[1], -half[1]]).T
    strip = max(16, CELLS // max(1, len(right.words)))
    most = max(1, CELLS * 16 // max(1, left.front.shape[1]))
    for s in range(0, len(left.words), strip):
        first = s if left is right else 0
        found = np.flatnonzero((x[s:s + strip] @ y[:, first:] >= -1).ravel())
        for k in range(0, len(found), most):
            i, j = np.divmod(found[k:k + most], len(right.words) - first)
            i, j = s + i, first + j
            if left is right:
                i, j = i[i < j], j[i < j]
            near = one_edit(left, i, right, j)
            yield from zip(i[near].tolist(), j[near].tolist())


def _effects(left: Side, right: Side, out: list[tuple]) -> None:
    """Adds what the near pairs of two sides mean for each word: (word, how many, n of the most frequent, that word)."""
    found: dict[str, list] = {}
    for i, j in near_pairs(left, right):
        a, b, n_a, n_b = left.words[i], right.words[j], left.n[i], right.n[j]
        for word, n, other in ((a, n_b, b), (b, n_a, a)):
            old = found.setdefault(word, [0, 0, other])
            old[0] += 1
            if n > old[1] or n == old[1] and other < old[2]:
                old[1], old[2] = n, other
    out.extend((word, *effect) for word, effect in found.items())


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block after block: the words at home against each other, then each batch of visiting words against them.

    Rows come sorted by block, words at home first, so one block and one batch are all that is held.
    """
    kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
    block, words, n, home, out = None, [], [], None, []

    def ready() -> None:
        nonlocal home
        if home is None and words:
            home = Side(words, n)
            _effects(home, home, out)

    def emptied() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "near", "best_n", "best"])

    for batch in batches:
        rows, first = batch.to_pydict(), 0
        for (name, visit), run in groupby(zip(rows["block"], rows["visit"])):
            last = first + sum(1 for _ in run)
            if name != block:
                ready()
                block, words, n, home = name, [], [], None
            if visit:
                ready()
                if home is not None:
                    _effects(home, Side(rows["word"][first:last], rows["n"][first:last]), out)
            else:
                words += rows["word"][first:last]
                n += rows["n"][first:last]
            first = last
        yield emptied()
    ready()
    yield emptied()


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, best_n, best) for each word of ``words`` (word, n) with a word one edit away.

    A word stays in one block of its own cell and visits the blocks of the cells listed by ``_moves``, and those blocks
    of its own cell that come after its own.
    """
    counts = F.array(*_class_counts())
    rows = words.select("word", "n", counts.alias("cell"))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    place = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    at_home = rows.join(sizes, "cell").select("word", "n", "cell", "blocks", place.alias("own"))
    moves = F.array(*[F.array(*[F.lit(x) for x in m]) for m in _moves()])
    others = rows.select("word", "n", F.explode(F.transform(moves, lambda m: F.zip_with("cell", m, lambda a, b: a + b))).alias("cell"))
    visits = others.join(sizes, "cell").select("word", "n", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    later = at_home.where(F.col("own") < F.col("blocks") - 1)
    later = later.select("word", "n", "cell", F.explode(F.sequence(F.col("own") + 1, F.col("blocks") - 1)).alias("block"))
    guests = visits.union(later).withColumn("visit", F.lit(1))
    here = at_home.select("word", "n", "cell", F.col("own").alias("block"), F.lit(0).alias("visit"))
    block_name = F.concat_ws(",", F.col("cell").cast("array<string>"), F.col("block").cast("string")).alias("block")
    met = here.union(guests).select("word", "n", block_name, "visit").repartition("block").sortWithinPartitions("block", "visit")
    met = met.mapInArrow(_meet, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b")
    met = met.groupBy("word").agg(F.sum("near").alias("near"), best)
    return met.select("word", "near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def spelling_variants(docs: DataFrame, rare: int | None = RARE, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``docs`` that ``word_counts`` gives.

    A word's form is its near word of largest n (ties: the smallest in code-point order) where that n is at least
    ``times`` the word's own, else null. The root is reached from the word by following forms to the last, and is the
    word itself where it has no form. Null and empty texts and empty tables give no words; other columns of
    ``docs`` are ignored.
    """
    words = settle(word_counts(docs, rare))
    best = near_words(words, block).withColumnRenamed("word", "near_word")
    has_form = F.col("best_n") >= F.col("n") * times
    rows = words.join(best, words["word"] == best["near_word"], "left").select(
        "word", F.when(has_form, F.col("best")).alias("form"), "n",
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best_n")).alias("form_n"),
    )
    rows = settle(rows)
    # n grows by ``times`` a step, so the way to the root is short; each round doubles the part that is known.
    steps = math.floor(math.log(max(1, rows.agg(F.max("n")).first()[0] or 1), max(2, times))) + 1
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps + 1))):
        links = settle(links)
        on = links.select(F.col("word").alias("via"), F.col("root").alias("next"))
        links = links.join(on, links["root"] == on["via"], "left").select("word", F.coalesce("next", "root").alias("root"))
    links = links.withColumnRenamed("word", "linked")
    out = rows.join(links, rows["word"] == links["linked"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
