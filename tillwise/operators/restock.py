"""Purchase cadence, restock candidates, store recommendation and the two-store plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tillwise.config import Config
from tillwise.functions.amounts import clamp01, half_even, iqr_stability, recency_score
from tillwise.functions.dates import days_after, days_before, elapsed_days, instant
from tillwise.functions.text import blank_to_null, norm_store_key
from tillwise.operators.stats import exact_medians, nearest_rank, top_rows
from tillwise.session import settle

MIN_PURCHASES = 3
FULL_HISTORY = 8

LOOKBACK_DAYS = 120
MAX_STALE_DAYS = 60
WINNER_MIN = 3
RUNNER_MIN = 2
MIN_MATCH_CONFIDENCE = 75
MIN_GAP = 0.02
TAG_CONFIDENCE = 0.75
RETAG_MARGIN = 0.10
MAX_STORES = 2
SWITCH_PENALTY = 0.05


def purchase_gaps(purchases: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Days between consecutive purchases of each group as (keys, gap, weight).

    Rows are chained inside each day and the days are chained over their first and last instants, so the
    purchases of one busy product are spread over tasks by day instead of being sorted in one.
    """
    keys = list(keys)
    points = purchases.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("_ts")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    points = points.withColumn("_day", F.to_date("_ts"))
    inside = (
        points.withColumn("_prev", F.lag("_ts").over(Window.partitionBy(*keys, "_day").orderBy("_ts")))
        .where(F.col("_prev").isNotNull())
        .select(*keys, elapsed_days(F.col("_prev"), F.col("_ts")).alias("gap"), F.lit(1).cast("long").alias("weight"))
    )
    days = points.groupBy(*keys, "_day").agg(F.min("_ts").alias("_first"), F.max("_ts").alias("_last"))
    between = (
        days.withColumn("_prev", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_day")))
        .where(F.col("_prev").isNotNull())
        .select(*keys, elapsed_days(F.col("_prev"), F.col("_first")).alias("gap"), F.lit(1).cast("long").alias("weight"))
    )
    same_instant = points.where("_c > 1").select(*keys, F.lit(0.0).alias("gap"), (F.col("_c") - 1).alias("weight"))
    gaps = inside.unionByName(between).unionByName(same_instant)
    return gaps.groupBy(*keys, "gap").agg(F.sum("weight").alias("weight"))


def restock_levels(
    purchases: DataFrame, as_of, keys: Sequence[str] = (), product: str = "product_id", ts: str = "observed_at"
) -> DataFrame:
    """Cadence, level and confidence of every product with a purchase.

    Fewer than three purchases or a cadence of zero give level ``medium`` with confidence 0.
    """
    group = [*keys, product]
    now = instant(as_of)
    dated = purchases.where(F.col(product).isNotNull() & F.col(ts).isNotNull())
    totals = dated.groupBy(*group).agg(F.count(F.lit(1)).alias("purchases"), F.max(ts).alias("last_purchase"))
    # The gaps feed two medians, the second of which needs the first; they are stored once.
    gaps = settle(purchase_gaps(dated, group, ts))
    cadence = exact_medians(gaps, group, "gap", "cadence", weight="weight").drop("n")
    spread = gaps.join(cadence, group).withColumn("_dev", F.abs(F.col("gap") - F.col("cadence")))
    deviation = exact_medians(spread, group, "_dev", "mad", weight="weight").drop("n")
    joined = totals.join(cadence.join(deviation, group), group, "left")
    known = (F.col("purchases") >= MIN_PURCHASES) & (F.col("cadence") > 0)
    ratio = F.try_divide(F.col("days_since_last"), F.col("cadence"))
    stability = 1.0 - F.least(F.lit(1.0), F.try_divide(F.col("mad"), F.col("cadence")))
    history = F.least(F.lit(1.0), F.col("purchases") / float(FULL_HISTORY))
    return (
        joined.withColumn("_known", F.coalesce(known, F.lit(False)))
        .withColumn("cadence", F.when(F.col("_known"), F.col("cadence")).otherwise(0.0))
        .withColumn("days_since_last", F.when(F.col("_known"), elapsed_days(F.col("last_purchase"), now)).otherwise(0.0))
        .withColumn(
            "level",
            F.when(~F.col("_known"), "medium").when(ratio < 0.7, "plenty").when(ratio < 1.0, "medium")
            .otherwise("likely_low"),
        )
        .withColumn("confidence", F.when(F.col("_known"), clamp01(0.6 * stability + 0.4 * history)).otherwise(0.0))
        .drop("_known")
    )


def restock_candidates(
    purchases: DataFrame, product_state: DataFrame, as_of, config: Config = Config(), keys: Sequence[str] = (),
    product: str = "product_id", ts: str = "observed_at",
) -> DataFrame:
    """Every product with its ``status``: ``candidate`` or the first reason to skip it."""
    group = [*keys, product]
    now = instant(as_of)
    state = product_state.select(*group, "last_auto_added_at", "last_seen_at")
    rows = restock_levels(purchases, as_of, keys, product, ts).join(state, group, "left")
    status = (
        F.when(F.col("purchases") < MIN_PURCHASES, "not_enough_history")
        .when(F.col("level") != "likely_low", "not_low")
        .when(F.col("confidence") < config.restock_confidence, "low_confidence")
        .when(now < days_after(F.col("last_auto_added_at"), config.cooldown_days), "cooldown")
    )
    if config.evidence_ttl_days > 0:
        status = status.when(now < days_after(F.col("last_seen_at"), config.evidence_ttl_days), "recently_seen")
    reason = F.format_string(
        "Typical cadence ~%.1fd; last bought %.0fd ago", F.col("cadence"), F.col("days_since_last")
    )
    rows = rows.withColumn("status", status.otherwise("candidate"))
    return rows.withColumn("reason", F.when(F.col("status") == "candidate", reason))


def resolve_store_alias(rows: DataFrame, store_aliases: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Replace a store name by its canonical name where the alias table has its key."""
    aliases = store_aliases.select(
        *keys, F.col("key").alias("_key"), F.nullif(F.trim("canonical"), F.lit("")).alias("_canonical")
    )
    keyed = rows.withColumn("_key", norm_store_key(F.col(column)))
    joined = keyed.join(aliases, [*keys, "_key"], "left")
    return joined.withColumn(column, F.coalesce("_canonical", column)).drop("_key", "_canonical")


def store_prices(
    obs: DataFrame, store_aliases: DataFrame | None, as_of, keys: Sequence[str] = (), min_confidence: int = MIN_MATCH_CONFIDENCE
) -> DataFrame:
    """Median, count, quartiles and last visit per product and store, for the product's most common unit."""
    group = [*keys, "product_id"]
    now = instant(as_of)
    rows = obs.where(
        (blank_to_null(F.col("store_name")).isNotNull()) & (F.col("unit_price") > 0)
        & (F.coalesce(F.col("confidence"), F.lit(0)) >= min_confidence)
        & (F.col("observed_at") >= days_before(now, LOOKBACK_DAYS)) & F.col("product_id").isNotNull()
    )
    rows = rows.withColumn("store_name", blank_to_null(F.col("store_name")))
    rows = rows.withColumn("unit_type", F.coalesce(blank_to_null(F.col("unit_type")), F.lit("unknown")))
    # Equal rows are counted once here; the alias join and all that follows run on the counts.
    prices = rows.groupBy(*group, "store_name", "unit_type", "unit_price").agg(
        F.count(F.lit(1)).alias("_c"), F.max("observed_at").alias("_last"),
        F.min(F.struct("observed_at", "line_item_id")).alias("_seen"),
    )
    if store_aliases is not None:
        prices = resolve_store_alias(prices, store_aliases, "store_name", keys)
    prices = prices.withColumnRenamed("store_name", "store")
    units = prices.groupBy(*group, "unit_type").agg(F.sum("_c").alias("_units"), F.min("_seen").alias("_seen"))
    common = units.groupBy(*group).agg(
        F.min(F.struct((-F.col("_units")).alias("neg"), "_seen", "unit_type")).alias("_u")
    ).select(*group, F.col("_u.unit_type").alias("unit_type"), (-F.col("_u.neg")).alias("_units")).where(
        F.col("_units") >= WINNER_MIN
    )
    kept = prices.join(common, [*group, "unit_type"])
    stats = exact_medians(
        kept, [*group, "store"], "unit_price", "median", weight="_c",
        extra={"q25": nearest_rank(0.25), "q75": nearest_rank(0.75)},
    )
    meta = kept.groupBy(*group, "store").agg(
        F.max("_last").alias("last_seen"), F.min("_seen").alias("_seen"), F.first("unit_type").alias("unit_type")
    )
    return stats.join(meta, [*group, "store"])


def store_recommendation(
    prices: DataFrame, as_of, keys: Sequence[str] = (), places: int | None = None
) -> DataFrame:
    """Cheapest store of each product against its runner-up, from the rows of :func:`store_prices`."""
    group = [*keys, "product_id"]
    now = instant(as_of)
    stale = (F.unix_micros(now) - F.unix_micros(F.col("last_seen"))) / 86_400_000_000.0
    ranked = top_rows(
        prices.where((F.col("n") >= WINNER_MIN) & (stale <= MAX_STALE_DAYS)),
        [F.col("median"), F.col("_seen"), F.col("store")], 2, group,
    )
    entry = F.struct("median", "_seen", "store", "n", "q25", "q75", "last_seen", "unit_type")
    pairs = ranked.groupBy(*group).agg(F.min(entry).alias("w"), F.max(entry).alias("r"), F.count(F.lit(1)).alias("_k"))
    gap = F.try_divide(F.col("r.median") - F.col("w.median"), F.col("r.median"))
    rows = pairs.where("_k = 2 and w.median > 0 and r.median > 0").withColumn("gap_pct", gap).where(
        F.col("gap_pct") >= MIN_GAP
    )
    sufficiency = 0.6 * clamp01(F.col("w.n") / float(WINNER_MIN)) + 0.4 * clamp01(F.col("r.n") / float(RUNNER_MIN))
    margin = clamp01((F.col("gap_pct") - 0.02) / 0.10)
    stability = F.when(
        F.col("w.n") >= 4, iqr_stability(F.col("w.q25"), F.col("w.q75"), F.col("w.median"))
    ).otherwise(F.lit(0.6))
    recency = recency_score(elapsed_days(F.col("w.last_seen"), now))
    confidence = clamp01(sufficiency * (0.45 * margin + 0.30 * stability + 0.25 * recency))
    return rows.select(
        *group, F.col("w.store").alias("store"), half_even(confidence, places or 3).alias("confidence"),
        F.col("w.unit_type").alias("unit_type"), half_even("w.median", places or 4).alias("winner_median"),
        F.col("r.store").alias("runner_up_store"), half_even("r.median", places or 4).alias("runner_up_median"),
        half_even("gap_pct", places or 4).alias("gap_pct"),
    )


def plan_stores(recs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The one or two stores that win most products: (keys, store, place), place 1 is the primary."""
    votes = recs.where((F.trim("store") != "") & (F.col("confidence") >= TAG_CONFIDENCE))
    counts = votes.groupBy(*keys, "store").agg(F.count(F.lit(1)).alias("wins"), F.min("product_id").alias("_first"))
    order = [F.col("wins").desc(), F.col("_first"), F.col("store")]
    best = top_rows(counts, order, MAX_STORES, keys)
    # At most two rows per tenant are left, so this window is bounded.
    tenant = list(keys) or [F.lit(0)]
    place = F.row_number().over(Window.partitionBy(*tenant).orderBy(*order))
    return best.withColumn("place", place).drop("_first")


def store_plan(recs: DataFrame, prices: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Planned store per recommended product: the primary store when it costs at most five percent more,
    else the winner, else the cheapest plan store with a known price."""
    group = [*keys, "product_id"]
    votes = recs.where((F.trim("store") != "") & (F.col("confidence") >= TAG_CONFIDENCE))
    plan = plan_stores(recs, keys).select(*keys, "store", "place")
    wanted = votes.select(*group, F.col("store").alias("best"), "confidence")
    # Prices of the recommended products only, marked with the plan place of their store.
    offers = (
        prices.select(*group, "store", "median").where("median > 0")
        .join(wanted, group)
        .join(F.broadcast(plan) if not keys else plan, [*keys, "store"], "left")
        .where("place is not null or store = best")
    )
    wide = offers.groupBy(*group, "best", "confidence").agg(
        F.max(F.when(F.col("store") == F.col("best"), F.col("median"))).alias("best_price"),
        F.max(F.when(F.col("place") == 1, F.struct("store", "median"))).alias("_primary"),
        F.max(F.when(F.col("store") == F.col("best"), F.col("place"))).alias("_best_place"),
        F.min(F.when(F.col("place").isNotNull(), F.struct("median", "place", "store"))).alias("_cheapest"),
    ).where("best_price > 0")
    penalty = F.try_divide(F.col("_primary.median") - F.col("best_price"), F.col("best_price"))
    chosen = (
        F.when(penalty <= SWITCH_PENALTY, F.col("_primary.store"))
        .when(F.col("_best_place").isNotNull(), F.col("best"))
        .otherwise(F.col("_cheapest.store"))
    )
    return wide.withColumn("planned_store", chosen).where("planned_store is not null").select(
        *group, "planned_store", "best", "confidence"
    )
