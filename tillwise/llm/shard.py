"""Sharding by a two-pass external shuffle.

The shard of a document follows from its id and the shard count by seeded hashes (highest weight wins), so one more
shard takes rows only into itself. Pass one scatters the rows of each shard uniformly into buckets small enough for a
task's memory, again by seeded hashes; pass two shuffles each bucket with Fisher-Yates and numbers or writes its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

SHARDS, BUCKET_BYTES, SEED = 40, 16 << 20, 20240229
ADDED = ("size", "shard", "grown_shard", "slot")


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """0 .. shards - 1: the shard whose seeded hash with the id is highest."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), doc_id, s).alias("w"), s.alias("s")))
    return F.array_max(weights).s


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` plus size (UTF-8 bytes of the text, a null text has none, plus 16), shard, grown_shard (with one shard
    more) and slot (the row's place in its shard, gapless from 0).

    Law ``key``: doc_id and the shard count decide; rows with the same id, null too, share a shard. Rows are
    put in a fixed order before the shuffle, so a lost task comes out the same; rows alike in all columns may change places.
    Columns of ``docs`` with the added names are replaced. An empty table gives no rows.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    # The seeded hash of the row picks its bucket: rows of one id spread unless they repeat the text's length as well.
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", F.octet_length("text")), F.lit(buckets)).cast("int")
    # The whole row travels as one column, so none of its names can clash.
    placed = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("tie"), size.alias("size"),
        shard_of(F.col("doc_id"), shards, seed).alias("shard"), shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"), bucket.alias("bucket"),
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    placed = placed.join(starts, ["shard", "bucket"])
    schema = T.StructType([placed.schema[c] for c in ("row", "size", "shard", "grown_shard")] + [T.StructField("slot", T.LongType())])

    def shuffle(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.select(["id", "tie"]), [("id", "ascending"), ("tie", "ascending")]))
        s, b, start = (table.column(c)[0].as_py() for c in ("shard", "bucket", "start"))
        order = list(range(table.num_rows))
        draws = np.random.default_rng([seed, s, b]).integers(0, np.arange(len(order), 0, -1))
        for i, d in enumerate(draws.tolist()):  # Fisher-Yates
            order[i], order[i + d] = order[i + d], order[i]
        out = table.select(["row", "size", "shard", "grown_shard"]).take(pa.array(order, pa.int64()))
        return out.append_column("slot", pa.array(start + np.arange(len(order)), pa.int64()))

    shuffled = placed.groupBy("shard", "bucket").applyInArrow(shuffle, schema)
    return shuffled.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in ADDED], *ADDED)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; the rows of each file lie in slot order."""
    sharded.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
