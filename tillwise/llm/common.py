"""What several of these operators share: document keys, Arrow text buffers, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tillwise.session import settle

#: A document is known by its id and the hash of its text: rows that repeat both get the same result, and
#: a missing or repeated id does no harm.
KEY = ["_id", "_th"]


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """(_id, _th, text, ...) of ``docs``; a null text counts as empty. Other columns are left out, so no name clashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("text"), *more)


def same_key(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on KEY that also lets a null id meet itself."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_th"])


def hex128(*columns: Column | str) -> Column:
    """32 hex digits from two 64-bit hashes: wide enough that distinct rows of a huge corpus do not collide."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *columns)), 16, "0") for seed in (1, 2)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without copying it per row; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def runs(offsets: np.ndarray, most: int = 1 << 20):
    """(first, last) row ranges whose bytes stay near ``most``, so that working arrays stay small whatever the batch."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges (a, b): for the links inside one block."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def components(edges: DataFrame) -> DataFrame:
    """(id, component): connected components of ``edges`` (a, b), named by their smallest id.

    Alternating large-star and small-star steps: each step replaces edges by edges to the smallest neighbour, so
    the edge list never grows and no component is gathered in one task. Each round is written to the checkpoint
    folder. Null ends and loops are dropped; ids without an edge are not returned.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    now = settle(edges.where("a is not null and b is not null and a != b").select(hi, lo).distinct())
    state = _state(now)
    while state[0]:
        both = now.union(now.select("lo", "hi"))
        least = both.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low"))
        least = least.select("node", F.least("node", "low").alias("low"))
        large = now.join(least, now.lo == least.node).select("hi", F.col("low").alias("lo")).where("hi != lo").distinct()
        least = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("low"))
        small = large.join(least, large.hi == least.node).select("lo", "low").where("lo != low")
        new = settle(small.select(F.col("lo").alias("hi"), F.col("low").alias("lo")).union(least).distinct())
        new_state = _state(new)
        if new_state == state:
            break
        now, state = new, new_state
    roots = now.select(F.col("lo").alias("id"), F.col("lo").alias("component"))
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
