"""From receipt texts to stored tables in one job: fields, store, category, items, products, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillwise.functions.categories import infer_category
from tillwise.functions.dates import instant
from tillwise.operators.derive import derive_observations, explode_items
from tillwise.operators.extract import extract_receipts
from tillwise.operators.maintain import SUBCATEGORY_ROWS, auto_category, auto_subcategories
from tillwise.operators.products import new_products
from tillwise.operators.restock import resolve_store_alias
from tillwise.operators.stores import HINT_FIELDS, assign_stores, enrich_stores, match_stores, new_stores
from tillwise.session import settle

#: Items of one document keep their order below the document's own.
ITEMS_PER_DOCUMENT = 1 << 24


def intake(
    docs: DataFrame, stores: DataFrame, store_aliases: DataFrame, as_of, products: DataFrame | None = None, currency: str = "kr"
) -> dict[str, DataFrame]:
    """``receipts, stores, line_items, observations, products, aliases`` after reading ``docs``.

    ``docs`` has the columns of :func:`extract_receipts`, ``receipt_id`` and a whole number ``arrival`` that orders the
    documents; hint columns (``org_number, phone, ...``) are used where it has them. A store name is replaced by its alias
    before the store is looked for; a receipt without a known store starts one. ``stores`` and ``products`` come back with
    what was learnt.
    """
    none = F.lit(None).cast("string")
    read = resolve_store_alias(extract_receipts(docs, as_of), store_aliases, "store_name")
    inferred = infer_category(F.col("store_name"), F.col("filename"), none, F.col("text"), F.col("receipt_category_model"))
    category, source = auto_category(F.lit(False), none, none, none, none, inferred)
    empty = F.lit(None).cast(SUBCATEGORY_ROWS)
    rows = auto_subcategories(empty, F.col("receipt_subcategories_model"), empty, F.col("receipt_category"), F.lit(True), F.col("total"))
    hints = {c: F.col(c) if c in docs.columns else none for c in ("branch_name", *HINT_FIELDS)}
    read = (
        read.withColumn("receipt_category", category).withColumn("receipt_category_source", source)
        .withColumn("receipt_subcategories", rows).withColumns(hints).withColumn("chain_name", F.col("store_name"))
        .withColumn("currency", F.lit(currency)).withColumn("extract_status", F.lit("done")).withColumn("created_at", instant(as_of))
        .drop("receipt_category_model", "receipt_subcategories_model")
    )
    # Stored once: stores, items and the receipts table all read it.
    matched = settle(match_stores(settle(read), stores))
    receipts = assign_stores(matched)
    order = receipts.select("receipt_id", (F.col("arrival") * ITEMS_PER_DOCUMENT).alias("_at"))
    items = explode_items(receipts).join(order, "receipt_id").withColumn("arrival", F.col("_at") + F.col("pos")).drop("_at")
    derived = derive_observations(receipts, items, products)
    fresh = new_products(derived["aliases"], as_of)
    return {
        **derived,
        "receipts": receipts.drop("chain_name", *hints, "learn_alias"),
        "stores": enrich_stores(stores, matched, as_of).unionByName(new_stores(matched, as_of), allowMissingColumns=True),
        "products": fresh if products is None else products.unionByName(fresh, allowMissingColumns=True),
    }
