"""Sequence packing as a cutting-stock problem solved by column generation.

Documents are encoded, ended with id 1 and cut into whole sequences and one remainder. The histogram of remainder
lengths (in steps of ``STEP`` ids, so of bounded size) is the demand of a linear program over patterns, the ways to fill a
sequence; a knapsack dynamic program prices new patterns until none improves. Patterns are rounded down, what is
left is packed best-fit-decreasing, and the documents, ranked within their length class, take the places of the patterns.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tillwise.llm.common import keyed
from tillwise.session import settle

LIMIT, STEP, END = 2048, 8, 1


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern for the given values: an unbounded knapsack by dynamic programming over the capacity."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for c in range(1, capacity + 1):
        n = fitting[c]
        best[c], pick[c] = best[c - 1], -1
        if n:
            gains = values[:n] + best[c - sizes[:n]]
            k = int(np.argmax(gains))
            if gains[k] > best[c] + 1e-12:
                best[c], pick[c] = gains[k], k
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used, in fractions) by the revised simplex method.

    Starts with one pattern per size; stops when no pattern improves the program or Farley's bound is within ``gap``.
    """
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    used = inverse @ demand
    for _ in range(200 * n + 1000):
        duals = inverse.sum(axis=0)
        value, pattern = price(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + max(1e-9, gap):
            break
        entering = inverse @ pattern
        ratios = np.where(entering > 1e-9, used / np.where(entering > 1e-9, entering, 1), np.inf)
        leave = int(np.argmin(ratios))
        row = inverse[leave] / entering[leave]
        inverse = inverse - np.outer(entering, row)
        inverse[leave] = row
        step = ratios[leave]
        used = np.maximum(used - step * entering, 0)
        used[leave] = step
        columns[:, leave] = pattern
    return columns.astype(np.int64), used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern as {size: how many}, times)] that holds every item of the histogram {size: count} exactly once."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n), np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    columns, used = solve(sizes, left.astype(float), capacity)
    out = []
    for k in np.argsort(-used):
        column = columns[:, k]
        times = int(used[k] + 1e-6)
        if column.any():
            times = min(times, int((left[column > 0] // column[column > 0]).min()))
        if times > 0 and column.any():
            out.append(({int(sizes[i]): int(column[i]) for i in np.flatnonzero(column)}, times))
            left -= times * column
    bins: dict[int, list[Counter]] = {}
    for size, n in zip(sizes[::-1].tolist(), left[::-1].tolist()):
        for _ in range(n):  # at most one pattern's items for each pattern
            room = next((r for r in range(size, capacity + 1) if bins.get(r)), None)
            box = bins[room].pop() if room is not None else Counter()
            box[size] += 1
            bins.setdefault((capacity if room is None else room) - size, []).append(box)
    same = Counter(tuple(sorted(box.items())) for boxes in bins.values() for box in boxes)
    return out + [(dict(pattern), n) for pattern, n in sorted(same.items())]


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """{size: rows of (first rank, first sequence, items per sequence)}: which ranks of a size go where."""
    out: dict[int, list] = {}
    taken: Counter = Counter()
    sequence = 0
    for pattern, times in patterns:
        for size, each in pattern.items():
            out.setdefault(size, []).append((taken[size], sequence, each))
            taken[size] += each * times
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


_ENCODERS: dict[str, object] = {}


def encoder(path: str, special: dict[str, int]):
    """The byte-level vocabulary at ``path`` (a table of ranks), with its special strings."""
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


#: Fixed value: the special string of the vocabulary and its id.
SPECIAL = {"<|endoftext|>": 50256}


def pieces(docs: DataFrame, vocabulary: str, limit: int = LIMIT, keep_ids: bool = False) -> DataFrame:
    """(_id, _th, start, length, ids_crc32, doc_tokens, ids): each document's ids, ended with END, cut every ``limit`` ids.

    ids_crc32 is over the little-endian 32-bit ids; ids is null unless ``keep_ids``.
    """
    source = keyed(docs)
    ids_type = pa.list_(pa.int32())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, SPECIAL).encode
        for batch in batches:
            row, start, length, crc, total, kept = [], [], [], [], [], []
            for r, text in enumerate(batch.column(2)):
                ids = np.array(encode(text.as_py(), allowed_special="all") + [END], dtype="<u4")
                for a in range(0, len(ids), limit):
                    part = ids[a:a + limit]
                    row.append(r)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    kept.append(part.astype(np.int32) if keep_ids else None)
            at = pa.array(row, pa.int64())
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *numbers, pa.array(kept, ids_type)], names=names)

    names = ["_id", "_th", "start", "length", "ids_crc32", "doc_tokens", "ids"]
    longs = [T.StructField(c, T.LongType()) for c in names[2:6]]
    schema = T.StructType([*source.schema.fields[:2], *longs, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return source.mapInArrow(cut, schema)


def pack(docs: DataFrame, vocabulary: str, limit: int = LIMIT, step: int = STEP, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A null or empty text is the END id alone. Sequences are numbered from 0 and hold at most ``limit`` ids, offsets
    are gapless from 0. Every row of ``docs`` is packed, repeated or not; other columns are ignored; an empty
    table gives no rows. The histogram on the driver has at most limit / step + 1 rows.
    """
    spark = docs.sparkSession
    cut = settle(pieces(docs, vocabulary, limit, keep_ids))
    units = limit // step
    # Class 0: whole sequences. Else the length in steps, rounded up, so that what fits in steps fits in ids.
    size = F.when(F.col("length") == limit, 0).otherwise(F.ceil(F.col("length") / step)).cast("int")
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("_id", "_th", "start"), F.lit(salts)).cast("int")
    sized = cut.withColumns({"size": size, "salt": salt})
    counts = sized.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = dict(counts.groupBy("size").agg(F.sum("n").alias("n")).collect())
    whole = histogram.pop(0, 0)
    patterns = ([({0: 1}, whole)] if whole else []) + plan(histogram, units)
    table = spark.sparkContext.broadcast(places(patterns))

    # Ranks within a class: within (class, salt), plus what lies in the salts before. One hot class is spread over the salts.
    before = F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("size", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("size", "salt").orderBy("_id", "_th", "start"))
    ranked = sized.withColumn("rank", inner - 1).join(starts, ["size", "salt"])
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("before")).cast("long"))

    @F.pandas_udf(T.LongType())
    def sequence_of(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        out = np.empty(len(sizes), np.int64)
        sizes, ranks = sizes.to_numpy(), ranks.to_numpy()
        for s in np.unique(sizes):
            mine = sizes == s
            rows = table.value[int(s)]
            at = np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1
            out[mine] = rows[at, 1] + (ranks[mine] - rows[at, 0]) // rows[at, 2]
        return pd.Series(out)

    placed = ranked.withColumn("sequence_id", sequence_of("size", "rank"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "size", "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")
    return placed.select(
        F.col("_id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"), "ids", "_th",
    )
