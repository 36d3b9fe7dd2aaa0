"""Order statistics and top rows that hold when one key owns a large share of the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS_PER_DOUBLING = 16


def top_rows(df: DataFrame, order: Sequence[Column], n: int | None, keys: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows, per key when there are keys; all rows, in no order, without ``n``.

    Each task keeps at most ``n`` rows per key before the shuffle.
    """
    if n is None:
        return df
    if not keys:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def value_bucket(value: Column) -> Column:
    """Whole number that never falls while the value rises; about 4 % relative width."""

    def magnitude(v: Column) -> Column:
        return F.floor(F.least(F.log2(v), F.lit(2000.0)) * BUCKETS_PER_DOUBLING) + 100_000

    # Never null, so that no null filter sets the two readers of the counts apart and their shuffle is shared.
    bucket = F.when(value > 0, magnitude(value)).when(value < 0, -magnitude(-value))
    return F.coalesce(bucket, F.lit(0)).cast("long")


def order_statistics(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    weight: str | None = None,
    count_name: str = "n",
) -> DataFrame:
    """Exact values at the given 0-based ranks of each group, with the group size.

    Equal values are counted together before any shuffle. Counts per value bucket then tell which bucket
    holds each wanted rank, and only rows of those buckets are ordered, so a huge group is never sorted
    in one task. ``ranks`` maps an output column to a function of the group size. Keys must not be null.
    """
    keys = list(keys)
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = (
        rows.where(reduce(and_, [F.col(c).isNotNull() for c in (value, *keys)]))
        .groupBy(*keys, value_bucket(F.col(value)).alias("_bucket"), F.col(value).alias("_value"))
        .agg(amount.alias("_w"))
    )
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    histogram = (
        counted.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_bw"))
        .withColumn("_upto", F.sum("_bw").over(by_bucket))
        .withColumn("_n", F.sum("_bw").over(Window.partitionBy(*keys)))
        .withColumn("_from", F.col("_upto") - F.col("_bw"))
    )
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), fn(F.col("_n")).cast("long").alias("rank")) for name, fn in ranks.items()]
    )
    hits = histogram.withColumn("_wanted", wanted).withColumn(
        "_wanted",
        F.expr("filter(_wanted, t -> t.rank >= _from and t.rank < _upto)"),
    ).where(F.size("_wanted") > 0).select(*keys, "_bucket", "_n", "_from", "_wanted")
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        counted.join(hits, [*keys, "_bucket"])
        .withColumn("_end", F.col("_from") + F.sum("_w").over(in_bucket))
        .withColumn("_hit", F.explode(F.expr("filter(_wanted, t -> t.rank >= _end - _w and t.rank < _end)")))
    )
    result = picked.groupBy(*keys).agg(
        F.max("_n").alias(count_name),
        *[F.max(F.when(F.col("_hit.name") == name, F.col("_value"))).alias(name) for name in ranks],
    )
    return result.drop("_all")


def nearest_rank(p: float) -> Callable[[Column], Column]:
    """0-based nearest rank of a percentile; halves go to the even rank."""
    return lambda n: F.bround((n - 1) * F.lit(float(p)), 0)


def exact_medians(
    rows: DataFrame, keys: Sequence[str], value: str, name: str = "median", weight: str | None = None,
    count_name: str = "n", extra: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Exact median and size of each group, with further ranked values when asked."""
    ranks = {
        "_low": lambda n: F.floor((n - 1) / 2),
        "_high": lambda n: F.floor(n / 2),
        **(extra or {}),
    }
    stats = order_statistics(rows, keys, value, ranks, weight, count_name)
    return stats.withColumn(name, (F.col("_low") + F.col("_high")) / 2.0).drop("_low", "_high")
