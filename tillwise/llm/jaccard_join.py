"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles. MinHash bands bring candidates together; a pair's MinHash values are then
compared in steps, and the pair is dropped as soon as the posterior probability that its similarity reaches the
threshold, given the agreements so far and a uniform prior, is below ``TOLERANCE``. What remains is verified exactly.

Equal shingle sets are one class, compared once. Classes that share a band are joined into clusters, clusters are cut
into blocks, and each pair of blocks is one task: the pairs live inside the task, which returns one row per class.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tillwise.llm import words as W
from tillwise.llm.common import components, keyed, local_labels, runs, utf8
from tillwise.session import settle

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a band with probability 1 - (1 - 0.8^6)^28 = 0.9998.
BANDS, ROWS = 28, 6
STEP, TOLERANCE, BLOCK, SEED = 16, 1e-6, 256, 5


def _lanes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


_MULTIPLY, _FLIP = _lanes()


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of a set, in pieces of bounded size."""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for i in range(0, len(high), 256):
        lanes = high[i:i + 256, None] ^ _FLIP
        lanes *= _MULTIPLY
        np.minimum(out, lanes.min(axis=0), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band and row of ``sig`` (n, BANDS * ROWS)."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        h = W.mix(h * np.uint64(0x100000001B3) + parts[:, :, r])
    return h.view(np.int64)


def fewest(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """fewest()[n]: agreements among n MinHash values below which P(similarity >= threshold) < tolerance. The posterior
    under a uniform prior is Beta(m + 1, n - m + 1), integrated on a grid."""
    n_all = BANDS * ROWS
    grid = (np.arange(20_000) + 0.5) / 20_000
    log, rest, high = np.log(grid), np.log1p(-grid), grid >= threshold
    out = np.zeros(n_all + 1, np.int64)
    for n in range(STEP, n_all + 1):
        for m in range(int(out[n - 1]), n + 1):
            density = np.exp(m * log + (n - m) * rest + lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1))
            if density[high].mean() * high.mean() >= tolerance:
                break
        out[n] = m
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a text of fewer words than SHINGLE has one, of all its words."""
    low, starts, ends, first = W.split(data, offsets)
    hashed = W.hashes(low, starts, ends)
    grams = W.grams(hashed, SHINGLE)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(grams[a:b - SHINGLE + 1])
        else:
            yield W.grams(hashed[a:b], b - a)[:1] if b > a else hashed[:0]


def prints(docs: DataFrame) -> DataFrame:
    """(_id, _th, digest, bands): per row the 128-bit digest of its shingle set and its band hashes; null without words."""
    import xxhash

    def emit(batches):
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            for r0, r1 in runs(offsets):
                off = offsets[r0:r1 + 1] - offsets[r0]
                digests, sigs, filled = [], [], []
                for s in shingle_sets(data[offsets[r0]:offsets[r1]], off):
                    filled.append(len(s) > 0)
                    digests.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                    if len(s):
                        sigs.append(signature(s))
                hashed = iter(bands(np.array(sigs)) if sigs else ())
                rows = [next(hashed) if f else None for f in filled]
                ids = [batch.column(c).slice(r0, r1 - r0) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(digests, pa.string()), pa.array(rows, pa.list_(pa.int64()))], names=["_id", "_th", "digest", "bands"])

    source = keyed(docs)
    schema = T.StructType([*source.schema.fields[:2], T.StructField("digest", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return source.mapInArrow(emit, schema)


def _sets(chosen: DataFrame) -> DataFrame:
    """(digest, cluster, blocks, block, weight, sig, shingles) of the documents in ``chosen``."""

    def emit(batches):
        for batch in batches:
            offsets, data = utf8(batch.column(5))
            for r0, r1 in runs(offsets):
                off = offsets[r0:r1 + 1] - offsets[r0]
                sets = list(shingle_sets(data[offsets[r0]:offsets[r1]], off))
                columns = [batch.column(c).slice(r0, r1 - r0) for c in range(5)]
                sig = pa.array([signature(s).tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, sig, pa.array([s.tobytes() for s in sets], pa.binary())], names=names)

    rows = chosen.select("digest", "cluster", "blocks", "block", "weight", "text")
    names = ["digest", "cluster", "blocks", "block", "weight", "sig", "shingles"]
    return rows.mapInArrow(emit, T.StructType([*rows.schema.fields[:5], T.StructField("sig", T.BinaryType()), T.StructField("shingles", T.BinaryType())]))


def similar(sig_a: np.ndarray, sig_b: np.ndarray, sets_a: list, sets_b: list, least: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a, b) with similarity >= threshold; with ``same`` the two sides are one block and a < b."""
    n_all = sig_a.shape[1]
    # The first steps for all rows at once; a pair goes on while its posterior allows it.
    agree = np.zeros((len(sig_a), len(sig_b)), np.int16)
    for r in range(STEP):
        agree += sig_a[:, r, None] == sig_b[None, :, r]
    a, b = np.nonzero(agree >= least[STEP])
    if same:
        a, b = a[a < b], b[a < b]
    count = agree[a, b].astype(np.int64)
    for k in range(STEP, n_all, STEP):
        top = min(n_all, k + STEP)
        for i in range(0, len(a), 1 << 16):
            part = slice(i, i + (1 << 16))
            count[part] += (sig_a[a[part], k:top] == sig_b[b[part], k:top]).sum(axis=1)
        on = count >= least[top]
        a, b, count = a[on], b[on], count[on]
    # Exact: shared shingles through numbered shingles of the b side, one row of a at a time.
    if not len(a):
        return a, b
    held = np.unique(b)
    place = np.full(len(sets_b), -1)
    place[held] = np.arange(len(held))
    flat = np.concatenate([sets_b[j] for j in held])
    owner = np.repeat(np.arange(len(held)), [len(sets_b[j]) for j in held])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    sizes_a, sizes_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    ok = np.zeros(len(a), bool)
    edges = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        mine = sets_a[a[i]]
        lo, hi = np.searchsorted(flat, mine, side="left"), np.searchsorted(flat, mine, side="right")
        n = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(held))[place[b[i:j]]]
        ok[i:j] = shared >= threshold * (sizes_a[a[i]] + sizes_b[b[i:j]] - shared) - 1e-9
    return a[ok], b[ok]


def _verified(sets: DataFrame, threshold: float) -> DataFrame:
    """(digest, other, n): links that each class has in each pair of blocks, and one link of a spanning forest there."""
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    wide = sets.select("digest", "cluster", "block", "weight", "sig", "shingles", F.explode(pair).alias("p"))
    wide = wide.select("digest", "cluster", "block", "weight", "sig", "shingles", "p.i", "p.j")
    least = fewest(threshold)

    def compare(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        digests = np.array(table.column("digest").to_pylist())
        order = np.unique(digests, return_index=True)[1]  # repeated rows of one document
        table, digests = table.take(pa.array(order)), digests[order]
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(digests), -1)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        weight, block = table.column("weight").to_numpy(), table.column("block").to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = similar(sig[left], sig[right], [sets[k] for k in left], [sets[k] for k in right], least, threshold, i == j)
        a, b = left[a], right[b]
        n = np.bincount(a, weight[b], len(digests)) + np.bincount(b, weight[a], len(digests))
        label = local_labels(len(digests), a, b)
        some = np.flatnonzero(n)
        return pa.table({"digest": digests[some].astype(object), "other": digests[label[some]].astype(object), "n": n[some].astype(np.int64)}, schema=schema)

    schema = pa.schema([("digest", pa.string()), ("other", pa.string()), ("n", pa.int64())])
    return wide.groupBy("cluster", "i", "j").applyInArrow(compare, "digest string, other string, n long")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id reachable over links), n_links (other rows linked
    directly, similarity >= threshold), kept (one row of each class), _th.

    Null and empty texts and texts without words link with nothing and are kept. Repeated rows are documents of
    their own that link with each other; of rows alike in doc_id and text one is kept. class_id is null where all
    ids of a class are null. Other columns are ignored; an empty table gives no rows.
    """
    rows = settle(prints(docs))
    row = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_th")  # null ids last
    classes = settle(rows.where("digest is not null").groupBy("digest").agg(F.min(row).alias("pick"), F.count(F.lit(1)).alias("weight"), F.first("bands").alias("bands")))
    keys = classes.select("digest", F.posexplode("bands").alias("band", "h"))
    shared = keys.groupBy("band", "h").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low != high")
    met = keys.join(shared, ["band", "h"]).select(F.col("digest").alias("a"), F.col("low").alias("b")).distinct()
    clusters = components(met).select(F.col("id").alias("digest"), F.col("component").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = clusters.join(sizes, "cluster").join(classes.select("digest", "pick", "weight"), "digest")
    members = members.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    members = members.select("digest", "cluster", "blocks", "block", "weight", F.col("pick._id").alias("m_id"), F.col("pick._th").alias("m_th"))
    texts = keyed(docs)
    chosen = texts.join(members, texts["_id"].eqNullSafe(members["m_id"]) & (texts["_th"] == members["m_th"]))
    links = settle(_verified(_sets(chosen), threshold))
    joined = components(links.select(F.col("digest").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("digest").agg(F.sum("n").alias("n"))
    per_class = classes.select("digest", "pick", "weight").join(counts, "digest", "left").join(joined.withColumnRenamed("id", "digest"), "digest", "left")
    per_class = per_class.withColumn("component", F.coalesce("component", "digest"))
    names = per_class.groupBy("component").agg(F.min("pick").alias("keep"))
    per_class = per_class.join(names, "component").select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "keep")
    out = rows.select("_id", "_th", "digest").join(per_class, "digest", "left")
    wordless = F.col("digest").isNull()
    kept = wordless | (row == F.col("keep"))
    return out.select(
        F.col("_id").alias("doc_id"), F.when(wordless, F.col("_id")).otherwise(F.col("keep._id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"), "_th",
    )
