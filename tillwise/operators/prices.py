"""Price baselines, overpaid items, price increases and the best store per product.

``places`` overrides the usual rounding of the shown numbers.

Observations have ``product_id, store_name, observed_at, unit_price, unit_type, line_item_id``; ``keys``
are optional leading columns (a tenant) that join every grouping.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tillwise.config import Config
from tillwise.functions.amounts import half_even
from tillwise.functions.dates import days_before, instant, iso_week
from tillwise.operators.stats import exact_medians, top_rows

RECENT_PURCHASE_DAYS = 60
MIN_SAVINGS = 0.05
MIN_PRICES = 3


def with_product_names(rows: DataFrame, products: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``product``: the canonical name, or the id of an unknown product."""
    names = products.select(*keys, "product_id", "canonical_name")
    named = rows.join(names, [*keys, "product_id"], "left")
    return named.withColumn("product", F.coalesce("canonical_name", F.col("product_id").cast("string"))).drop("canonical_name")


def price_baselines(obs: DataFrame, window_n: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Median of the last ``window_n`` unit prices of every product with at least three of them."""
    group = [*keys, "product_id"]
    priced = obs.where(F.col("product_id").isNotNull() & F.col("unit_price").isNotNull())
    counts = priced.groupBy(*group).agg(F.count(F.lit(1)).alias("count")).where("count >= 3")
    newest_first = [F.col("observed_at").desc(), F.col("line_item_id").desc()]
    recent = top_rows(priced.select(*group, "observed_at", "line_item_id", "unit_price"), newest_first, window_n, group)
    # At most window_n rows a group are left, so the built-in median is bounded here.
    baselines = recent.groupBy(*group).agg(F.median("unit_price").alias("baseline"))
    return baselines.join(counts, group).withColumn("confidence", F.least(F.lit(100), F.col("count") * 20).cast("int"))


def recent_baselines(obs: DataFrame, window_n: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """The baselines of :func:`price_baselines` without their counts, in one pass over the observations.

    The newest rows of a group tell by themselves whether it has enough prices.
    """
    group = [*keys, "product_id"]
    priced = obs.where(F.col("product_id").isNotNull() & F.col("unit_price").isNotNull())
    newest = Window.partitionBy(*group).orderBy(F.col("observed_at").desc(), F.col("line_item_id").desc())
    ranked = priced.select(*group, "observed_at", "line_item_id", "unit_price").withColumn("_rank", F.row_number().over(newest))
    rows = ranked.where(F.col("_rank") <= max(window_n, MIN_PRICES)).groupBy(*group).agg(
        F.median(F.when(F.col("_rank") <= window_n, F.col("unit_price"))).alias("baseline"), F.count(F.lit(1)).alias("_n")
    )
    return rows.where(F.col("_n") >= MIN_PRICES).drop("_n")


def overpaid_items(
    obs: DataFrame, products: DataFrame, as_of, config: Config = Config(), keys: Sequence[str] = (), limit: int | None = None,
    places: int | None = None,
) -> DataFrame:
    """This week's purchases well above the product's own baseline."""
    group = [*keys, "product_id"]
    now = instant(as_of)
    week = iso_week(now)
    current = obs.where((F.col("observed_at") >= week) & (F.col("observed_at") < week + F.expr("INTERVAL 7 DAYS")))
    current = current.where(F.col("unit_price").isNotNull())
    baselines = recent_baselines(obs, config.baseline_window, keys).where("baseline > 0")
    over = current.join(baselines, group).where(
        (F.col("unit_price") >= F.col("baseline") * (1 + config.overpaid_pct))
        & (F.col("unit_price") - F.col("baseline") >= config.overpaid_floor)
    ).withColumn("overpaid_pct", F.try_divide(F.col("unit_price") - F.col("baseline"), F.col("baseline")))
    order = [F.col("overpaid_pct").desc(), F.col("observed_at"), F.col("line_item_id")]
    best = with_product_names(top_rows(over, order, limit, keys), products, keys)
    return best.select(
        *keys, "product", F.col("store_name").alias("store"), half_even("unit_price", places or 2).alias("unit_price"),
        half_even("baseline", places or 2).alias("baseline"), half_even("overpaid_pct", places or 3).alias("overpaid_pct"),
        "observed_at", "line_item_id",
    )


def top_price_increases(
    obs: DataFrame, products: DataFrame, as_of, config: Config = Config(), keys: Sequence[str] = (), limit: int | None = None,
    places: int | None = None,
) -> DataFrame:
    """Products whose recent median price is above their earlier one."""
    group = [*keys, "product_id"]
    now = instant(as_of)
    recent_from = days_before(now, config.increase_recent_days)
    prior_from = days_before(now, config.increase_prior_days)
    valid = obs.where(
        F.col("product_id").isNotNull() & F.col("unit_price").isNotNull() & F.col("observed_at").isNotNull()
    )
    unit = F.nullif("unit_type", F.lit(""))
    totals = valid.groupBy(*group).agg(
        F.count(F.lit(1)).alias("observations"),
        F.min(F.when(unit.isNotNull(), F.struct("observed_at", "line_item_id", unit.alias("unit_type")))).alias("_first"),
    )
    part = F.when(F.col("observed_at") >= recent_from, "recent").otherwise("prior")
    windowed = valid.where(F.col("observed_at") >= F.least(recent_from, prior_from)).withColumn("_part", part)
    medians = exact_medians(windowed, [*group, "_part"], "unit_price", "_median", count_name="_n")
    wide = medians.groupBy(*group).agg(
        *[
            F.max(F.when(F.col("_part") == p, F.col(c))).alias(f"{p}{c}")
            for p in ("recent", "prior") for c in ("_median", "_n")
        ]
    )
    rising = (
        wide.where("recent_n >= 1 and prior_n >= 1 and prior_median > 0 and recent_median > prior_median")
        .join(totals, group)
        .where("recent_n >= 2 or observations >= 3")
        .withColumn("increase_pct", F.try_divide(F.col("recent_median") - F.col("prior_median"), F.col("prior_median")))
    )
    best = top_rows(rising, [F.col("increase_pct").desc(), F.col("product_id")], limit, keys)
    return with_product_names(best, products, keys).select(
        *keys, "product", half_even("increase_pct", places or 3).alias("increase_pct"),
        half_even("recent_median", places or 2).alias("recent_median"), half_even("prior_median", places or 2).alias("prior_median"),
        F.coalesce("_first.unit_type", F.lit("unknown")).alias("unit_type"), "observations",
    )


def best_store_by_item(
    obs: DataFrame, products: DataFrame, as_of, config: Config = Config(), keys: Sequence[str] = (), limit: int | None = None,
    places: int | None = None,
) -> DataFrame:
    """The store with the lowest median price of each product, when it saves at least five percent."""
    group = [*keys, "product_id"]
    now = instant(as_of)
    rows = obs.where(
        F.col("product_id").isNotNull() & F.col("unit_price").isNotNull()
        & (F.col("observed_at") >= days_before(now, config.best_store_days))
    ).withColumn("_store", F.coalesce(F.nullif("store_name", F.lit("")), F.lit("Unknown")))
    unit = F.nullif("unit_type", F.lit(""))
    # One row per product, store and price; everything below works on these counts.
    prices = rows.groupBy(*group, "_store", "unit_price").agg(
        F.count(F.lit(1)).alias("_c"),
        F.sum((F.col("observed_at") >= days_before(now, RECENT_PURCHASE_DAYS)).cast("long")).alias("_recent"),
        F.min(F.struct("observed_at", "line_item_id")).alias("_seen"),
        F.min(F.when(unit.isNotNull(), F.struct("observed_at", "line_item_id", unit.alias("unit_type")))).alias("_unit"),
    )
    totals = prices.groupBy(*group).agg(
        F.sum("_c").alias("_total"), F.sum("_recent").alias("_recent"), F.min("_unit").alias("_unit")
    ).where("(_total >= 4 or _recent >= 2) and _total >= 2")
    overall = exact_medians(prices, group, "unit_price", "overall_median", weight="_c").where("overall_median > 0")
    first_seen = prices.groupBy(*group, "_store").agg(F.min("_seen").alias("_seen"))
    per_store = exact_medians(prices, [*group, "_store"], "unit_price", "_median", weight="_c").where("n >= 2")
    cheapest = per_store.join(first_seen, [*group, "_store"]).groupBy(*group).agg(
        F.min(F.struct("_median", "_seen", "_store")).alias("_best")
    )
    savings = F.try_divide(F.col("overall_median") - F.col("_best._median"), F.col("overall_median"))
    found = (
        totals.join(overall.drop("n"), group).join(cheapest, group)
        .withColumn("savings_pct", savings).where(F.col("savings_pct") >= MIN_SAVINGS)
    )
    best = top_rows(found, [F.col("savings_pct").desc(), F.col("product_id")], limit, keys)
    return with_product_names(best, products, keys).select(
        *keys, "product", F.col("_best._store").alias("best_store"), half_even("_best._median", places or 2).alias("best_median"),
        half_even("overall_median", places or 2).alias("overall_median"), half_even("savings_pct", places or 3).alias("savings_pct"),
        F.coalesce("_unit.unit_type", F.lit("unknown")).alias("unit_type"),
    )
