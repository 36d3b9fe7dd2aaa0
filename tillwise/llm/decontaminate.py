"""Benchmark decontamination by winnowing.

Of every ``window`` consecutive words the smallest hash among its ``gram``-word runs is kept as a fingerprint, with
``window = gram + slide - 1``. Two texts that share ``window`` words share the run of hashes, hence the smallest one
(the last on ties), so every shared span of that length is met by a common fingerprint. Document fingerprints are
joined with those of the item windows; each hit is extended to the whole window by comparing the words.
Items of fewer words than ``window`` are one window; for their lengths every run of that many words is a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillwise.llm import words as W
from tillwise.llm.common import hex128, keyed, runs, utf8

WINDOW, GRAM = 10, 5
#: Size of the bitmap that spares documents without any item fingerprint the shuffle: 1 MiB, whatever the benchmark.
BITMAP = 1 << 23


def winnow(grams: np.ndarray, ok: np.ndarray, slide: int) -> tuple[np.ndarray, np.ndarray]:
    """(window start, place of its smallest gram, the last on ties) for windows of ``slide`` grams that lie in one text.

    ``ok`` marks the starts of windows that do.
    """
    n = len(grams) - slide + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, place = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, slide):
        place[grams[j:j + n] <= best] = j
        np.minimum(best, grams[j:j + n], out=best)
    start = np.flatnonzero(ok[:n])
    return start, start + place[start]


def _family(n: int, window: int, gram: int) -> tuple[int, int]:
    """(words per gram, grams per window) for windows of n words."""
    return (gram, window - gram + 1) if n == window else (n, 1)


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(span, h, at, body, items): each distinct window of the items, its fingerprint ``h`` at word ``at``, its words
    and the sorted ids of the items that hold it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), {"item_id": [], "span": [], "h": [], "at": [], "body": []}
            offsets, data = utf8(batch.column(1))
            low, starts, ends, first = W.split(data, offsets)
            hashed = W.hashes(low, starts, ends)
            for r in range(len(offsets) - 1):
                a, b = int(first[r]), int(first[r + 1])
                if a == b:
                    continue
                span = min(window, b - a)
                k, slide = _family(span, window, gram)
                grams = W.grams(hashed[a:b], k)
                start, place = winnow(grams, np.ones(len(grams), bool), slide)
                own = [low[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])]
                for s, p in zip(start.tolist(), place.tolist()):
                    rows["item_id"].append(ids[r].as_py())
                    rows["span"].append(span)
                    rows["h"].append(int(grams[p].astype(np.int64)))
                    rows["at"].append(p - s)
                    rows["body"].append(" ".join(own[s:s + span]))
            yield pa.RecordBatch.from_pydict(rows, schema=out)

    out = pa.schema([("item_id", batch_type(items, "item_id")), ("span", pa.int32()), ("h", pa.int64()), ("at", pa.int32()), ("body", pa.string())])
    spark_type = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", spark_type), T.StructField("span", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("body", T.StringType())])
    rows = items.where("text is not null").select("item_id", "text").mapInArrow(emit, schema)
    return rows.groupBy("span", "h", "at", "body").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def batch_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def candidates(docs: DataFrame, spans: list[int], bitmap, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_id, _th, n_words, found): per document its word count and the fingerprints that the bitmap lets through, each
    with the words around it: ``before`` words of ``around`` come before the fingerprint."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            for r0, r1 in runs(offsets):
                off = offsets[r0:r1 + 1] - offsets[r0]
                low, starts, ends, first = W.split(data[offsets[r0]:offsets[r1]], off)
                hashed = W.hashes(low, starts, ends)
                found: list[list[dict]] = [[] for _ in range(r1 - r0)]
                for span in spans:
                    k, slide = _family(span, window, gram)
                    grams = W.grams(hashed, k)
                    ok = W.inside(first, span, max(0, len(grams) - slide + 1))
                    _, place = winnow(grams, ok, slide)
                    place = place[np.r_[True, place[1:] != place[:-1]]] if len(place) else place
                    slot = grams[place] & np.uint64(BITMAP - 1)
                    place = place[(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0]
                    for p, row in zip(place.tolist(), (np.searchsorted(first, place, side="right") - 1).tolist()):
                        a, b = max(int(first[row]), p - slide + 1), min(int(first[row + 1]), p + span)
                        around = [low[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])]
                        found[row].append({"span": span, "h": int(grams[p].astype(np.int64)), "word": p - int(first[row]), "before": p - a, "around": around})
                columns = [batch.column(0).slice(r0, r1 - r0), batch.column(1).slice(r0, r1 - r0), pa.array(np.diff(first), pa.int64()), pa.array(found, FOUND)]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_th", "n_words", "found"])

    schema = T.StructType([*keyed(docs).schema.fields[:2], T.StructField("n_words", T.LongType()), T.StructField("found", T.ArrayType(T.StructType.fromDDL("span int, h long, word int, before int, around array<string>")))])
    return keyed(docs).mapInArrow(emit, schema)


FOUND = pa.list_(pa.struct([("span", pa.int32()), ("h", pa.int64()), ("word", pa.int32()), ("before", pa.int32()), ("around", pa.list_(pa.string()))]))


def _union_length(ranges: Column) -> Column:
    """Number of places in a sorted array of (a, b) ranges, b exclusive."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(ranges, start, lambda s, x: F.struct(
        (s.n + F.greatest(F.lit(0), x.b - F.greatest(s.end, x.a))).alias("n"), F.greatest(s.end, x.b).alias("end")
    ), lambda s: s.n)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document row: (doc_id, n_words, hits, n_hit, item_ids, contaminated).

    ``hits`` are the (a, b) word ranges, b exclusive, of all item windows in the document, ``n_hit`` the words they
    cover, ``item_ids`` the ids of items with such windows, sorted as strings. Null and empty texts have no words;
    items without words match nothing, null item ids are left out of the list. Rows that repeat a doc_id with
    the same text each return a row. An empty benchmark hits nothing. Extra columns of either side are ignored.
    """
    spark = docs.sparkSession
    wins = item_windows(items, window, gram)
    # At most ``window`` distinct lengths and BITMAP distinct slots come to the driver, however large the benchmark.
    spans = sorted(r[0] for r in wins.select("span").distinct().collect())
    slots = wins.select(F.col("h").bitwiseAND(F.lit(BITMAP - 1)).cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()
    bits = np.zeros(BITMAP, np.uint8)
    bits[slots] = 1
    bitmap = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))
    found = candidates(docs, spans, bitmap, window, gram)
    # A document without candidates keeps one row whose fingerprint is its own hash, of a span that no item has, so
    # such rows spread evenly.
    rows = found.withColumn("_row", F.monotonically_increasing_id())
    rows = rows.select("_id", "_th", "_row", "n_words", F.explode_outer("found").alias("f"))
    rows = rows.select(
        "_id", "_th", "_row", "n_words", F.coalesce("f.span", F.lit(0)).alias("span"), F.coalesce("f.h", "_th").alias("h"),
        F.col("f.word").alias("word"), F.col("f.before").alias("before"), F.col("f.around").alias("around"),
    )
    hits = rows.join(wins, ["span", "h"], "left")
    start = F.col("before") - F.col("at")
    body = F.array_join(F.slice("around", start + 1, F.col("span")), " ")
    real = (start >= 0) & (start + F.col("span") <= F.size("around")) & (body == F.col("body"))
    hits = hits.withColumn("real", F.when(F.col("at").isNotNull() & (start >= 0), real).otherwise(False))
    a = F.col("word") - F.col("at")
    out = hits.groupBy("_id", "_th", "_row").agg(
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("real"), F.struct(a.alias("a"), (a + F.col("span")).alias("b"))))).alias("hits"),
        F.collect_set(F.when(F.col("real"), F.col("items"))).alias("lists"),
    )
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten("lists")), lambda x: x.cast("string")))
    return out.select(
        F.col("_id").alias("doc_id"), "_th", "n_words", "hits", _union_length(F.col("hits")).alias("n_hit"),
        ids.alias("item_ids"), (F.size("hits") > 0).alias("contaminated"),
    )
