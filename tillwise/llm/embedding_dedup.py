"""Embedding near-dedup by sorted projection passes.

In each pass the vectors are put in lexicographic order of the signs of seeded random projections (32 signs, as one
number), the order is cut into blocks of ``BLOCK`` vectors, and each block is compared with itself and the next one by
cosine in double precision. Vectors that these links connect are one cluster; clusters are cut into blocks of their
own, and each pair of blocks is one task that counts its links. Every pair of a cluster is so compared exactly once
and no list of pairs is ever written: n_links misses nothing inside a cluster, however many vectors it has.

The number of passes follows from the number of vectors: a pair at the threshold agrees on the signs that single out
a block with a known probability, and enough passes are made to meet such a pair with probability ``RECALL``. Where
vectors crowd, those signs single out a cell of more vectors than a block and the next one hold. A cell of up to
``SPAN`` blocks is then compared whole in its pass, a larger one becomes part of one cluster, so that the probability
holds however the vectors are spread.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tillwise.llm.common import components, local_labels
from tillwise.session import settle

THRESHOLD, BLOCK, RECALL, SIGNS, SEED, PER_JOB, STRIP, SPAN, WIDE, COPIES = 0.9, 512, 0.995, 32, 77, 4, 256, 16, 4, 12


def passes_for(n: int, block: int = BLOCK, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Passes that meet a pair at the threshold with probability ``recall``: log2(n / block) signs must agree in one."""
    agree = 1 - math.acos(threshold) / math.pi
    met = agree ** max(0.0, math.log2(max(1, n) / block))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else 4


def cell_signs(n: int, block: int = BLOCK) -> int:
    """Leading signs that single out a cell: of n vectors spread evenly, a cell holds one to two blocks."""
    return min(SIGNS, max(0, int(math.log2(max(1, n) / block))))


def usable(vector: Column) -> Column:
    """Vectors that can be compared: not null, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _codes(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    """(key, dim, pass, code, tie): the sign code of each vector in each pass."""

    def emit(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, out = batch.column(0), []
            lengths = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), passes * SIGNS))
                x = batch.column(1).take(pa.array(at)).flatten().to_numpy().astype(float).reshape(len(at), int(dim))
                bits = (x @ planes[dim] >= 0).reshape(len(at), passes, SIGNS)
                codes = bits @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
                out.append(pa.RecordBatch.from_arrays([
                    keys.take(pa.array(np.repeat(at, passes))), pa.array(np.full(len(at) * passes, dim, np.int32)),
                    pa.array(np.tile(np.arange(passes, dtype=np.int32), len(at))), pa.array(codes.ravel()),
                ], names=["key", "dim", "pass", "code"]))
            yield from out

    schema = "key string, dim int, pass int, code long"
    return vectors.select("key", "embedding").mapInArrow(emit, schema).withColumn("tie", F.xxhash64("key", "pass"))


def _blocks(codes: DataFrame, block: int, signs: int) -> DataFrame:
    """(key, dim, pass, cell, block): the leading ``signs`` of the code as cell, and blocks numbered in sort order within (dim, pass), by one range sort and a small table of
    how many rows of each (dim, pass) lie in each sorted partition."""
    order = ["dim", "pass", "code", "tie"]
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = codes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    cell = F.shiftright("code", SIGNS - signs).alias("cell")
    ordered = settle(ordered.select("key", "dim", "pass", cell, part.alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    from pyspark.sql import Window

    # One row per (dim, pass, sorted partition).
    counts = ordered.groupBy("dim", "pass", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("dim", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("dim", "pass", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return ordered.join(counts, ["dim", "pass", "part"]).select("key", "dim", "pass", "cell", F.floor((F.col("at") + F.col("shift")) / block).cast("long").alias("block"))


def _cells(blocks: DataFrame) -> DataFrame:
    """``blocks`` with, for a vector in a cell of more than two blocks, ``whole`` (a number below -1 for the cell) or,
    in one of more than SPAN, ``least`` (the least key of the cell)."""
    cells = blocks.groupBy("dim", "pass", "cell").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.min("key").alias("least"))
    wide, crowded = F.col("high") > F.col("low") + 1, F.col("high") >= F.col("low") + SPAN
    cells = cells.select("dim", "pass", "cell", F.when(wide & ~crowded, -2 - F.col("cell")).alias("whole"), F.when(crowded, F.col("least")).alias("least"))
    return blocks.join(cells, ["dim", "pass", "cell"]).select("key", "pass", "block", "whole", "least")


def _unit(table: pa.Table) -> np.ndarray:
    """The vectors of ``table``, all of one length, scaled to norm 1."""
    x = table.column("embedding").combine_chunks().flatten().to_numpy().astype(float).reshape(table.num_rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _strips(x: np.ndarray, first: int, right: int, threshold: float):
    """Index pairs a < b of similar rows, a below ``first`` and b from ``right`` on, for a strip of rows a at a time, so
    that the working arrays stay small."""
    for r in range(0, first, STRIP):
        a, b = np.nonzero(x[r:min(first, r + STRIP)] @ x[right:].T >= threshold)
        a, b = a + r, b + right
        yield a[a < b], b[a < b]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (smallest index reachable from each row) after the links (a, b) are added."""
    known = np.flatnonzero(label != np.arange(len(label)))
    return local_labels(len(label), np.r_[known, a], np.r_[label[known], b])


def _met(rows: DataFrame, lo: int, hi: int, threshold: float) -> DataFrame:
    """(a, b): one link of a spanning forest for each vector linked within a block and the next one, or within a cell
    compared whole, in the passes lo to hi - 1."""
    wide = rows.select("key", "dim", "embedding", F.explode(F.slice("places", lo + 1, hi - lo)).alias("at"))
    groups = F.filter(F.array("at.block", F.col("at.block") - 1, "at.whole"), lambda g: g.isNotNull() & (g != -1))
    wide = wide.select("key", "dim", "embedding", F.col("at.pass").alias("pass"), F.explode(groups).alias("group"), F.col("at.block").alias("own"))
    wide = wide.withColumn("own", F.when(F.col("group") < 0, F.col("group")).otherwise(F.col("own")))

    def compare(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        table = table.take(pa.array(np.argsort(table.column("own").to_numpy(), kind="stable")))
        first = int((table.column("own").to_numpy() == group).sum())
        if not first:
            return schema.empty_table()
        x = _unit(table)
        label = np.arange(len(x))
        for a, b in _strips(x, first, 0, threshold):
            label = _joined(label, a, b)
        some = np.flatnonzero(label != np.arange(len(x)))
        key = table.column("key")
        return pa.Table.from_arrays([key.take(pa.array(some)), key.take(pa.array(label[some]))], schema=schema)

    schema = pa.schema([("a", pa.string()), ("b", pa.string())])
    return wide.groupBy("dim", "pass", "group").applyInArrow(compare, "a string, b string")


def _links(classes: DataFrame, clusters: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """(key, other, n): key's links in each pair of blocks of its cluster, and one link of a spanning forest there.

    Clusters of one block share tasks of a few blocks, so that many small clusters are not many tasks.
    """
    size = F.count(F.lit(1))
    # A vector is copied once per block of its cluster, so blocks grow before their number does.
    number = F.greatest(F.least(F.ceil(size / block), F.lit(COPIES)), F.ceil(size / (COPIES * block))).cast("int")
    sizes = clusters.groupBy("cluster").agg(number.alias("blocks"))
    packs = max(1, n // block)
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(packs)).cast("string")).otherwise(F.col("cluster"))
    rows = classes.select("key", "dim", "embedding", "weight").join(clusters.join(sizes, "cluster"), "key")
    rows = rows.withColumn("pack", pack).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    wide = rows.select("key", "dim", "embedding", "weight", "cluster", "pack", "block", F.explode(pair).alias("p"))
    wide = wide.select("key", "dim", "embedding", "weight", "cluster", "pack", "block", "p.i", "p.j")

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        table = table.sort_by([("cluster", "ascending"), ("block", "ascending")])
        x, weight, block_of = _unit(table), table.column("weight").to_numpy(), table.column("block").to_numpy()
        cluster = table.column("cluster").combine_chunks().dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1], True])
        count, label = np.zeros(len(x), np.int64), np.arange(len(x))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            first, w, near = int((block_of[lo:hi] == i).sum()), weight[lo:hi], np.arange(hi - lo)
            for a, b in _strips(x[lo:hi], first, 0 if i == j else first, threshold):
                count[lo:hi] += (np.bincount(a, w[b], hi - lo) + np.bincount(b, w[a], hi - lo)).astype(np.int64)
                near = _joined(near, a, b)
            label[lo:hi] = near + lo
        some = np.flatnonzero(count)
        key = table.column("key")
        return pa.Table.from_arrays([key.take(pa.array(some)), key.take(pa.array(label[some])), pa.array(count[some])], schema=schema)

    schema = pa.schema([("key", pa.string()), ("other", pa.string()), ("n", pa.int64())])
    return wide.groupBy("dim", "pack", "i", "j").applyInArrow(compare, "key string, other string, n long")


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors are compared once and link with each other (cosine 1). Vectors that are null, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths. Repeated rows are vectors of their
    own with one id. A component whose ids are all null has a null id and keeps nothing. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding").withColumn("good", usable(F.col("embedding")))
    exact = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(s), "embedding")), 16, "0") for s in (1, 2)])
    rows = rows.withColumn("key", F.when(F.col("good"), exact).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))))
    classes = rows.where("good").groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"),
    )
    classes = settle(classes.withColumn("dim", F.size("embedding")))
    n = classes.count()
    passes = passes_for(n, block, threshold, recall)
    blocks = settle(_cells(_blocks(_codes(classes, passes, seed), block, cell_signs(n, block))))
    by_pass = blocks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pass", "block", "whole"))).alias("places"))
    located = settle(classes.select("key", "dim", "embedding").join(by_pass, "key"))
    met = blocks.where("least is not null").select(F.col("key").alias("a"), F.col("least").alias("b"))
    for lo in range(0, passes, PER_JOB):  # a few passes at a time, so that the copies on disk stay few
        found = settle(_met(located, lo, min(passes, lo + PER_JOB), threshold))
        met = met.union(found)
    clusters = components(met).withColumnRenamed("id", "key").withColumnRenamed("component", "cluster")
    links = settle(_links(classes, clusters, n, threshold, WIDE * block))
    joined = components(links.select(F.col("key").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("key").agg(F.sum("n").alias("n"))
    per_class = classes.select("key", "least", "weight").join(counts, "key", "left").join(joined.withColumnRenamed("id", "key"), "key", "left")
    per_class = per_class.withColumn("component", F.coalesce("component", "key"))
    names = per_class.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = per_class.join(names, "component").select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "good", "key").join(per_class, "key", "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
