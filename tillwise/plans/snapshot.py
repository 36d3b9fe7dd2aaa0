"""All result tables of one refresh."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from tillwise.config import Config
from tillwise.operators import activities, inventory, prices, quality, spend
from tillwise.session import settle


def snapshot(tables: dict[str, DataFrame], as_of, config: Config = Config(), keys: Sequence[str] = (), persist: bool = False, settled: bool = False) -> dict[str, DataFrame]:
    """Result tables by name from ``receipts, items, observations, products, product_state, activities``.

    With ``settled`` the facts (receipts, items, observations) are worked out once and written to the checkpoint folder, so
    that each is scanned once however many results read it and lost executors cost nothing; with ``persist`` the
    receipts and observations are kept on the executors instead.
    """
    if settled:
        tables = tables | {name: settle(tables[name]) for name in ("receipts", "items", "observations")}
    receipts, obs, products = tables["receipts"], tables["observations"], tables["products"]
    if persist:
        receipts = receipts.persist(StorageLevel.MEMORY_AND_DISK)
        obs = obs.persist(StorageLevel.MEMORY_AND_DISK)
    categories = spend.category_period_totals(receipts, as_of, keys)
    subcategories = spend.subcategory_period_totals(receipts, as_of, keys)
    return {
        "spend_totals": spend.spend_totals(receipts, as_of, keys),
        "receipt_status_counts": quality.receipt_status_counts(receipts, keys),
        "processing_timing": quality.processing_timing(receipts, as_of, keys),
        "recent_receipts": quality.recent_receipts(receipts, keys),
        "recent_activities": activities.recent_activities(tables["activities"], keys),
        "inventory_recently_seen": inventory.inventory_recently_seen(
            products, tables["product_state"], as_of, config.evidence_ttl_days, keys
        ),
        "top_price_increases": prices.top_price_increases(obs, products, as_of, config, keys),
        "overpaid_items": prices.overpaid_items(obs, products, as_of, config, keys),
        "best_store_by_item": prices.best_store_by_item(obs, products, as_of, config, keys),
        "spend_by_category_periods": spend.spend_by_category_periods(receipts, as_of, keys),
        "spend_by_subcategory_periods": spend.spend_by_subcategory_periods(receipts, as_of, keys),
        "category_meta": spend.truncation_meta(categories, spend.CATEGORY_ROWS, keys),
        "subcategory_meta": spend.truncation_meta(subcategories, spend.SUBCATEGORY_ROWS, keys),
        "unknown_category_receipts": quality.unknown_category_receipts(receipts, keys),
        "unknown_subcategory_items": quality.unknown_subcategory_items(receipts, tables["items"], keys),
    }


#: A whole-number column of a result whose sum tells more than its number of rows.
MEASURES = {
    "receipt_status_counts": "count", "processing_timing": "count", "top_price_increases": "observations", "spend_by_category_periods": "receipt_count",
    "spend_by_subcategory_periods": "receipt_count", "category_meta": "returned_rows", "subcategory_meta": "returned_rows", "unknown_subcategory_items": "count",
}


def snapshot_sizes(results: dict[str, DataFrame]) -> DataFrame:
    """(result, row_count, measured) of every result table; measured sums the column that ``MEASURES`` names."""
    none = F.lit(None).cast("long")
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count"), (F.sum(F.col(MEASURES[name]).cast("long")) if name in MEASURES else F.max(none)).alias("measured"))
        .select(F.lit(name).alias("result"), "row_count", "measured")
        for name, df in sorted(results.items())
    ]
    return reduce(DataFrame.unionByName, parts)
