"""The restock run: candidates, store plan and the changes to an open shopping list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillwise.config import Config
from tillwise.functions.dates import instant
from tillwise.functions.text import apply_marker, blank_to_null, list_key, split_store_tag, strip_marker
from tillwise.operators.restock import (
    RETAG_MARGIN, TAG_CONFIDENCE, plan_stores, restock_candidates, store_plan, store_prices, store_recommendation,
)
from tillwise.session import settle


def display_names(
    candidates: DataFrame, products: DataFrame, translations: DataFrame | None, language: str | None,
    config: Config, keys: Sequence[str] = (),
) -> DataFrame:
    """Adds ``name``: a translation that is sure enough, else the canonical name, else the id."""
    group = [*keys, "product_id"]
    rows = candidates.join(products.select(*group, "canonical_name"), group, "left")
    base = F.coalesce(blank_to_null(F.col("canonical_name")), F.col("product_id").cast("string"))
    if translations is None or not config.translate_names or not language:
        return rows.withColumn("name", base).drop("canonical_name")
    sure = translations.where((F.col("lang") == language) & (F.col("confidence") >= config.translation_confidence))
    sure = sure.where(F.trim("name") != "").groupBy(*group).agg(F.max(F.struct("confidence", F.trim("name").alias("n")))["n"].alias("_t"))
    return rows.join(sure, group, "left").withColumn("name", F.coalesce("_t", base)).drop("canonical_name", "_t")


def reconcile_shopping_list(
    candidates: DataFrame, shopping_list: DataFrame, product_state: DataFrame, config: Config = Config(),
    dry_run: bool = False, keys: Sequence[str] = (),
) -> DataFrame:
    """What to do for every candidate: ``action`` add, rename or already_present.

    ``candidates`` has ``product_id, name, confidence, reason, planned_store, store_confidence``;
    ``shopping_list`` has ``id, name, complete``. Of several candidates with one base name only the surest acts.
    """
    group = [*keys, "product_id"]
    marker, position = config.item_marker, config.item_marker_position
    listed_base, listed_store = split_store_tag(F.col("name"))
    open_items = (
        shopping_list.where(~F.coalesce("complete", F.lit(False)))
        .withColumn("_key", list_key(strip_marker(listed_base, marker, position))).withColumn("_tag", listed_store)
        .where("_key <> ''")
        .groupBy(*keys, "_key").agg(F.min(F.struct("id", "name", F.col("_tag").alias("tag"))).alias("_item"))
    )
    tagged = F.col("planned_store").isNotNull() & (F.coalesce("store_confidence", F.lit(0.0)) >= TAG_CONFIDENCE)
    rows = candidates.withColumn("_key", list_key(F.col("name"))).where("_key <> ''").withColumn(
        "_plain", apply_marker(F.col("name"), marker, position)
    ).withColumn("new_name", F.when(tagged, F.concat_ws(" @ ", "_plain", "planned_store")).otherwise(F.col("_plain")))
    first = rows.groupBy(*keys, "_key").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "product_id"))["product_id"].alias("_first"))
    state = product_state.select(
        *group, F.coalesce("last_store_tag_confidence", F.lit(0.0)).alias("_prev"),
        *[F.col(c).alias(f"previous_{c}") for c in ("last_auto_added_at", "last_store_tag", "last_store_tag_confidence")],
    )
    rows = rows.join(open_items, [*keys, "_key"], "left").join(first, [*keys, "_key"]).join(state, group, "left")
    sure = F.coalesce("store_confidence", F.lit(0.0))
    retag = F.col("_item.tag").isNull() | (
        sure >= F.greatest(F.lit(TAG_CONFIDENCE), F.coalesce("_prev", F.lit(0.0)) + RETAG_MARGIN)
    )
    is_first = F.col("product_id") == F.col("_first")
    action = (
        F.when(F.col("_item").isNull(), F.when(F.lit(dry_run) | is_first, "add").otherwise("already_present"))
        .when(list_key(F.col("_item.name")) == list_key(F.col("new_name")), "already_present")
        .when(tagged & retag & is_first & F.lit(not dry_run), "rename")
        .otherwise("already_present")
    )
    return rows.withColumn("action", action).select(
        *group, "action", "new_name", F.col("_item.name").alias("old_name"),
        F.when(F.col("action") != "add", F.col("_item.id")).alias("shopping_list_item_id"),
        F.col("planned_store").alias("store"),
        F.when(F.col("planned_store").isNotNull(), F.bround("store_confidence", 3)).alias("store_confidence"),
        F.bround("confidence", 3).alias("confidence"), "reason", "previous_last_auto_added_at", "previous_last_store_tag",
        "previous_last_store_tag_confidence",
    )


def shopping_state_updates(decisions: DataFrame, as_of, keys: Sequence[str] = ()) -> DataFrame:
    """New and previous state of every product that was added or renamed."""
    return decisions.where(F.col("action").isin("add", "rename")).select(
        *keys, "product_id", instant(as_of).alias("last_auto_added_at"), F.col("store").alias("last_store_tag"),
        F.col("store_confidence").alias("last_store_tag_confidence"),
        "previous_last_auto_added_at", "previous_last_store_tag", "previous_last_store_tag_confidence",
    )


def auto_shopping_run(
    obs: DataFrame, products: DataFrame, product_state: DataFrame, shopping_list: DataFrame, as_of,
    config: Config = Config(), store_aliases: DataFrame | None = None, translations: DataFrame | None = None,
    language: str | None = None, dry_run: bool = False, paused: bool = False, keys: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """One restock run as tables: ``decisions``, ``skipped``, ``plan`` and ``state_updates``."""
    group = [*keys, "product_id"]
    # One row per product, and one per product and store below: both are read several times, so they are
    # stored once instead of being planned and computed again by every reader.
    rows = settle(restock_candidates(obs, product_state, as_of, config, keys))
    candidates = rows.where((F.col("status") == "candidate") & F.lit(not paused)).select(*group, "confidence", "reason")
    wanted = obs.join(candidates.select(*group), group, "left_semi")
    prices = settle(store_prices(wanted, store_aliases, as_of, keys))
    recs = store_recommendation(prices, as_of, keys)
    planned = store_plan(recs, prices, keys).select(*group, "planned_store")
    rated = candidates.join(recs.select(*group, F.col("confidence").alias("store_confidence")), group, "left").join(
        planned, group, "left"
    )
    named = display_names(rated, products, None if dry_run else translations, language, config, keys)
    decisions = reconcile_shopping_list(named, shopping_list, product_state, config, dry_run, keys)
    return {
        "decisions": decisions,
        "skipped": rows.where("status <> 'candidate'").select(*group, "status"),
        "plan": plan_stores(recs, keys),
        "state_updates": shopping_state_updates(decisions.where(F.lit(not dry_run)), as_of, keys),
    }
