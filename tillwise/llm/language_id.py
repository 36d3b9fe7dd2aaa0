"""Language identification by language-bitmask n-gram filters.

Of a bounded, seeded sample of labelled documents, the letter n-grams that a stated share of a language's documents
hold are put into a bit-sliced Bloom filter: every slot is a bitmask with one bit per language, so one look-up (the
AND of an n-gram's slots) gives all languages that contain it. A text's n-grams are looked up, each language's
bits are counted, the counts are corrected for the filter's false positives, and the highest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: At most about SAMPLE labelled documents per language are learned from (a seeded hash of the id picks them); an n-gram
#: belongs to a language if SHARE of these hold it. A language then has at most (n-grams per document) / SHARE n-grams.
SAMPLE, SHARE, GRAM, HASHES = 5_000, 0.02, 4, 2
UNKNOWN = "und"
_TABLE: list[np.ndarray] = []
_SPACE = 32


def letters() -> np.ndarray:
    """Lower-case letter of each code point, or a space for what is no letter."""
    if not _TABLE:
        table = np.full(0x110000, _SPACE, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def text_grams(texts: list[str], n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram, offsets per text). The second character of an n-gram is a letter and no two spaces follow
    in a row; texts are framed by spaces, so that words at their ends count too."""
    joined = "".join(f" {t} " + " " * (n - 2) for t in texts)
    codes = letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    ends = np.cumsum([len(t) + n for t in texts])
    m = max(0, len(codes) - n + 1)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x100000001B3) + codes[j:j + m].astype(np.uint64)
    space = codes == _SPACE
    # The second place is a letter; no two spaces follow it, so no n-gram crosses from one text into the next.
    keep = ~space[1:m + 1]
    for j in range(2, n):
        later = space[j:j + m] & space[j - 1:j - 1 + m]
        keep &= ~later
    at = np.flatnonzero(keep)
    h = h[at]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29)), np.searchsorted(at, np.r_[0, ends])


class LanguageFilter:
    """Bit-sliced Bloom filter: ``slots[s]`` holds one bit per language, 64 languages to a word."""

    def __init__(self, languages: list[str], grams: list[np.ndarray]):
        self.languages = languages
        most = max([len(g) for g in grams] or [0])
        self.size = 1 << max(10, int(16 * most).bit_length())
        self.slots = np.zeros((self.size, max(1, -(-len(languages) // 64))), np.uint64)
        for i, g in enumerate(grams):
            for s in self._places(g):
                np.bitwise_or.at(self.slots[:, i // 64], s, np.uint64(1 << (i % 64)))
        filled = [self._bits(self.slots, i).mean() for i in range(len(languages))]
        self.false = np.array([f ** HASHES for f in filled])

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        return [((h >> np.uint64(20 * k)) & np.uint64(self.size - 1)).astype(np.int64) for k in range(HASHES)]

    @staticmethod
    def _bits(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Bitmask of all languages that contain each n-gram."""
        first, *rest = self._places(h)
        masks = self.slots[first]
        for s in rest:
            masks &= self.slots[s]
        return masks

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) per text; ties go to the first language by name. A text whose letters all stand alone has
        no n-gram: every language scores 0."""
        h, offsets = text_grams(texts)
        lettered = [k > 0 or any(map(str.isalpha, t)) for k, t in zip(np.diff(offsets), texts)]
        masks = self.lookup(h)
        n = np.diff(offsets)
        shares = np.zeros((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            sums = np.r_[0, np.cumsum(self._bits(masks, i))].astype(float)
            hits = sums[offsets[1:]] - sums[offsets[:-1]]
            shares[:, i] = (hits - n * self.false[i]) / (np.maximum(n, 1) * (1 - self.false[i]))
        best = shares.argmax(axis=1)
        score = np.clip(shares[np.arange(len(texts)), best], 0, 1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, lettered)]
        return names, np.where(n > 0, score, 0.0)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(labelled: DataFrame, sample: int = SAMPLE, share: float = SHARE) -> LanguageFilter:
    """The filter of the rows (doc_id, text, lang) of ``labelled``; rows without text or lang are left out.

    The driver sees one row per language and the n-grams kept, whose number is bounded as stated above.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    totals = dict(rows.groupBy("lang").count().collect())
    languages = sorted(totals)
    if not languages:
        return LanguageFilter([], [])
    rates = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / totals[lang]))])
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) / 1e6
    taken = rows.where(draw < F.element_at(rates, F.col("lang")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            texts = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                mine = [texts[i] for i in np.flatnonzero(langs == lang)]
                seen = []
                for i in range(0, len(mine), 200):
                    h, offsets = text_grams(mine[i:i + 200])
                    seen += [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                grams, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = taken.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sizes = dict(taken.groupBy("lang").count().collect())
    least = F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(max(1, share * sizes.get(lang, 0))))])
    kept = counts.where(F.col("n") >= F.element_at(least, F.col("lang"))).select("lang", "gram").toArrow()
    of = np.array(kept.column("lang").to_pylist(), dtype=object)
    grams = kept.column("gram").to_numpy().view(np.uint64)
    return LanguageFilter(languages, [grams[of == lang] for lang in languages])


def identify(docs: DataFrame, languages: LanguageFilter) -> DataFrame:
    """``docs`` plus lang_pred and score (0 to 1: the share of the text's n-grams that the language contains).

    ``und`` with score 0 where the text is null or has no letters, or where no language was learned. Only the text
    is read; columns of ``docs`` called lang_pred or score are replaced. Nothing is shuffled.
    """
    rows = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(languages)
    text_at = rows.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            names, scores, first = [], [], 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= 1 << 19):
                    size += len(texts[last])
                    last += 1
                if filt.languages:
                    got = filt.decide(texts[first:last])
                else:
                    got = [UNKNOWN] * (last - first), np.zeros(last - first)
                names += got[0]
                scores += got[1].tolist()
                first = last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(predict, schema)
