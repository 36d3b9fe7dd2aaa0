"""Substring dedup by sliding sentence spans.

Every run of three consecutive sentences is hashed and equal runs are joined over the whole corpus. Places covered by
runs that another document had before are merged into spans, and spans of enough words are removed: they
are copied passages. Sentences here end at clause marks too, so that a passage which begins or ends in the middle of
a sentence still holds whole runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tillwise.llm.common import runs, utf8
from tillwise.llm.repeats import merged
from tillwise.llm.words import mix
from tillwise.session import settle

RUN = 3
#: A removed span has at least so many words: shorter ones ("Yes. No. Well.") recur by chance and are no copied passage.
MIN_WORDS = 30
#: Marks that end a sentence or clause, in several scripts, and line breaks.
STOPS = ".!?,;:\n。！？、，；：।॥؟،؛۔…"
#: A sentence ends with a run of such marks; the pieces put together are the text.
SENTENCE = f"[^{STOPS}]*[{STOPS}]+|[^{STOPS}]+"
#: Letters of scripts that are written without spaces between words (Thai to Lao, Kana, Han): each counts as a word.
SPACELESS = "ก-໿ぁ-ヿ㐀-䶿一-鿿"
WORD = f"[{SPACELESS}]|[^ \t\n\x0b\f\r{SPACELESS}]+"
WHITE = " \t\n\x0b\f\r"


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(sentences: list[str], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(h1, h2, a, b) of each run of ``run`` consecutive non-blank sentences, compared without white space around them:
    128 bits of hash in two halves, and the places of its first and last sentence."""
    trimmed = [s.strip(WHITE) for s in sentences]
    at = np.array([i for i, s in enumerate(trimmed) if s], np.int32)
    n = max(0, len(at) - run + 1)
    halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s) for s in trimmed if s]), np.uint64).reshape(-1, 2)
    out = np.zeros((n, 2), np.uint64)
    for j in range(run):
        out = out * _FACTOR + halves[j:j + n]
    h = mix(out).view(np.int64)
    return h[:, 0], h[:, 1], at[:n], at[run - 1:run - 1 + n]


def runs_of(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(_id, _th, h1, h2, a, b) of each run of sentences of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile(SENTENCE).findall
        for batch in batches:
            for first, last in runs(utf8(batch.column(2))[0]):
                found = [run_hashes(cut(t), run) for t in batch.column(2).slice(first, last - first).to_pylist()]
                rows = pa.array(np.repeat(np.arange(first, last), [len(f[0]) for f in found]))
                columns = [batch.column(c).take(rows) for c in (0, 1)] + [pa.array(np.concatenate(c)) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_th", "h1", "h2", "a", "b"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("text"))
    return rows.mapInArrow(work, T.StructType([
        *rows.schema.fields[:2], T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
        T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
    ]))


def repeated(wins: DataFrame, own: bool = False) -> DataFrame:
    """(_id, _th, ranges): per document the merged ranges of sentences that lie in a run met before.

    Before means in a document of smaller (id, text hash), or, with ``own``, earlier in the same one too. The first
    places are combined before the shuffle and runs of one document only are dropped. What is left is written before
    it is joined, one row per run: so both sides of the join are plain shuffles, and adaptive skew handling can split a
    run that a third of the documents share.
    """
    place = F.struct("_id", "_th", "a") if own else F.struct("_id", "_th")
    first = wins.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = settle(first.where(F.col("first") != F.col("last")).select("h1", "h2", "first"))
    later = wins.join(first, ["h1", "h2"]).where(place != F.col("first")).select("_id", "_th", F.struct("a", "b").alias("r"))
    return merged(later)


def without(text: str, ranges: list[dict], min_words: int) -> tuple[str | None, int, int]:
    """(text without the ranges of at least ``min_words`` words, sentences, sentences removed); the text is None where
    nothing is removed."""
    units = re.findall(SENTENCE, text)
    word = re.compile(WORD).findall
    gone = [r for r in ranges if sum(len(word(u)) for u in units[r["a"]:r["b"] + 1]) >= min_words]
    if not gone:
        return None, len(units), 0
    ends, starts = [-1, *[r["b"] for r in gone]], [*[r["a"] for r in gone], len(units)]
    kept = "".join("".join(units[end + 1:start]) for end, start in zip(ends, starts))
    return kept, len(units), sum(r["b"] - r["a"] + 1 for r in gone)


def substring_dedup(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, own: bool = False) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, plus n_sentences and n_removed.

    A passage goes where it is covered by runs of ``run`` sentences that a document of smaller (doc_id, text hash) holds, if
    the covered sentences side by side have ``min_words`` words together; letters of scripts without spaces count
    as words. Repeats inside one document stay unless ``own`` is set, then they go under the same rule. Null text
    stays null with 0 sentences, an empty text has 0; texts of fewer than ``run`` sentences are left alone. Rows that
    repeat a doc_id with the same text are one document; a null doc_id sorts first. Extra columns are kept, those
    called n_sentences or n_removed are replaced.
    """
    gone = repeated(runs_of(docs, run), own)
    # The whole row travels as one column, so none of its names can clash; sentences are split again after the join.
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    left = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("row_id"), th.alias("row_th"))
    both = left.join(gone, left["row_id"].eqNullSafe(gone["_id"]) & (left["row_th"] == gone["_th"]), "left")

    @F.arrow_udf("text string, n_sentences long, n_removed long")
    def cut(text: pa.Array, ranges: pa.Array) -> pa.Array:
        found = [without(t or "", r or [], min_words) for t, r in zip(text.to_pylist(), ranges.to_pylist())]
        columns = list(zip(*found)) or [()] * 3
        kinds = (pa.string(), pa.int64(), pa.int64())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["text", "n_sentences", "n_removed"])

    both = both.withColumn("cut", cut(F.col("row.text"), F.col("ranges")))
    new = {"text": F.coalesce(F.col("cut.text"), F.col("row.text")), "n_sentences": F.col("cut.n_sentences"), "n_removed": F.col("cut.n_removed")}
    rest = {c: F.col("row").getField(c) for c in docs.columns}
    return both.select(*[c.alias(name) for name, c in (rest | new).items()])
