"""Line items and price observations from receipts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillwise.functions.amounts import price_of, quantity_count, quantity_found, quantity_parts, quantity_text
from tillwise.functions.text import blank_to_null
from tillwise.operators.products import match_products


def explode_items(receipts: DataFrame) -> DataFrame:
    """Nested ``line_items_raw`` as rows (receipt_id, pos, raw_name, line_total, qty_raw, unit_price_raw)."""
    rows = receipts.select("receipt_id", F.posexplode("line_items_raw").alias("pos", "_i"))
    return rows.select("receipt_id", "pos", "_i.*")


def usable_items(receipts: DataFrame, items: DataFrame) -> DataFrame:
    """Items with a name and a total, of dated receipts, with the store and time of their receipt."""
    heads = receipts.where(F.col("purchased_at").isNotNull()).select("receipt_id", "store_name", "purchased_at")
    named = items.withColumn("raw_name", blank_to_null(F.col("raw_name"))).withColumn("qty_raw", blank_to_null(F.col("qty_raw")))
    return named.where("raw_name is not null and line_total is not null").join(heads, "receipt_id")


def priced_items(items: DataFrame) -> DataFrame:
    """Adds ``unit_price`` and ``unit_type``; the price is null where the item gives none.

    Each step of reading the quantity is a column of its own, which Spark works out once and in compiled code; inside one
    expression only a lambda could keep a step, and lambdas are interpreted row by row.
    """
    text = items.withColumn("_text", quantity_text(F.col("qty_raw")))
    found = text.withColumn("_at", quantity_found(F.col("_text")))
    qty, unit = quantity_parts(F.col("_at"))
    parts = found.withColumns({"_qty": qty, "_unit": unit}).withColumn("_count", quantity_count(F.col("_qty"), F.col("_text")))
    price = price_of(F.col("line_total"), F.col("unit_price_raw"), F.col("_qty"), F.col("_unit"), F.col("_count"))
    # A generated column: filters on the price are not pushed below it, where they would repeat all steps.
    priced = parts.withColumn("_price", price).drop("_text", "_at", "_qty", "_unit", "_count").withColumn("_found", F.explode(F.array("_price")))
    return priced.withColumn("unit_price", F.col("_found.price")).withColumn("unit_type", F.col("_found.unit")).drop("_price", "_found")


def derive_observations(
    receipts: DataFrame, items: DataFrame, products: DataFrame | None = None, keys: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """``line_items``, ``observations`` and ``aliases`` of the given receipts.

    ``items`` has ``receipt_id, pos, raw_name, line_total, qty_raw, unit_price_raw`` and a whole-number
    ``arrival``; with ``keys``, both tables carry the columns of a tenant. Replace the stored rows of these receipts with the result (see :func:`replace_rows`).
    """
    matched, aliases = match_products(usable_items(receipts, items), products, keys=keys)
    lines = priced_items(matched).withColumn("line_item_id", F.concat_ws("-", "receipt_id", "pos"))
    line_items = lines.select(
        *keys, "line_item_id", "receipt_id", "raw_name", "line_total", "qty_raw", "unit_price_raw",
        F.col("product_id").alias("matched_product_id"), "match_confidence",
    )
    observations = lines.where("unit_price is not null").select(
        *keys,
        F.col("line_item_id").alias("observation_id"), "product_id", "store_name",
        F.col("purchased_at").alias("observed_at"), F.col("line_total").alias("pack_price"), "unit_price", "unit_type",
        F.col("match_confidence").alias("confidence"), "receipt_id", "line_item_id",
    )
    return {"line_items": line_items, "observations": observations, "aliases": aliases}


def replace_rows(stored: DataFrame, derived: DataFrame, receipts: DataFrame) -> DataFrame:
    """Stored rows with those of ``receipts`` replaced by the derived ones."""
    kept = stored.join(receipts.select("receipt_id"), "receipt_id", "left_anti")
    return kept.unionByName(derived, allowMissingColumns=True)
