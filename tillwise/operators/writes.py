"""Receipts added, updated or read again: one plan through alias, store, category, subcategories and items.

Each entry point returns the same tables: ``receipts`` after the write, ``stores`` with what was learnt and created, and
``changes``, the row-level feed that a store of tables applies and that tells whose observations are to be derived anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tillwise.functions.categories import category_alias, infer_category
from tillwise.functions.dates import instant
from tillwise.functions.text import blank_to_null, normalize_store_name
from tillwise.operators import maintain
from tillwise.operators.maintain import SUBCATEGORY_ROWS, auto_category, auto_subcategories
from tillwise.operators.restock import resolve_store_alias
from tillwise.operators.stores import HINT_FIELDS, assign_stores, enrich_stores, learn_store_aliases, match_stores, new_stores
from tillwise.session import pin, settle

#: The fields whose change is a change of the receipt.
COMPARED = (
    "total", "purchased_at", "store_name", "store_entity_id", "receipt_category", "receipt_category_source", "receipt_subcategories", "line_items_raw",
)
#: A change of one of these moves the receipt's observations.
OBSERVED = ("store_name", "purchased_at")


def place_stores(
    named: DataFrame, stores: DataFrame, store_aliases: DataFrame, as_of, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """((*keys, receipt_id, store_name, store_entity_id), stores after): where receipts with a new store name were bought.

    ``named`` has ``receipt_id, store_name`` and, where there are any, ``branch_name`` and the hint fields. A name is
    replaced by its alias, then the store is looked for; a name that no store has starts one. The receipt takes the
    chain name of its store. Rows without a name are left out.
    """
    keys = list(keys)
    none = F.lit(None).cast("string")
    hints = {c: F.col(c) if c in named.columns else none for c in ("branch_name", *HINT_FIELDS)}
    rows = named.where(blank_to_null(F.col("store_name")).isNotNull()).select(
        *keys, "receipt_id", F.col("store_name").alias("chain_name"), *[c.alias(name) for name, c in hints.items()])
    matched = settle(match_stores(resolve_store_alias(rows, store_aliases, "chain_name", keys), stores, keys))
    after = enrich_stores(stores, matched, as_of, keys).unionByName(new_stores(matched, as_of, keys), allowMissingColumns=True)
    after = settle(after)
    chains = after.select(*keys, "store_entity_id", F.col("chain_name").alias("_canonical"))
    placed = assign_stores(matched, keys).join(chains, [*keys, "store_entity_id"], "left")
    return placed.select(*keys, "receipt_id", F.coalesce(blank_to_null(F.col("_canonical")), "chain_name").alias("store_name"), "store_entity_id"), after


def change_feed(before: DataFrame, after: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(*keys, receipt_id, kind, fields, before, after, reprocess) for each receipt that differs.

    kind is insert, update or delete; fields lists the changed ones of ``COMPARED``; before and after hold their
    values. reprocess tells that observations follow: a receipt with items was added, or its items, store or date changed.
    """
    keys = list(keys)
    old = before.select(*keys, "receipt_id", F.struct(*COMPARED).alias("before"))
    new = after.select(*keys, "receipt_id", F.struct(*COMPARED).alias("after"))
    both = new.join(old, [*keys, "receipt_id"], "full_outer")
    differs = {c: ~F.col("before").getField(c).eqNullSafe(F.col("after").getField(c)) for c in COMPARED}
    fields = F.filter(F.array(*[F.when(d, F.lit(c)) for c, d in differs.items()]), lambda f: f.isNotNull())
    kind = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    some = [F.coalesce(F.size(f"{side}.line_items_raw") > 0, F.lit(False)) for side in ("before", "after")]
    has_items = some[0] | some[1]
    moved = F.lit(False)
    for c in OBSERVED:
        moved = moved | differs[c]
    reprocess = (differs["line_items_raw"] | moved) & has_items
    rows = both.select(*keys, "receipt_id", kind.alias("kind"), fields.alias("fields"), "before", "after", reprocess.alias("reprocess"))
    return rows.where((F.col("kind") != "update") | (F.size("fields") > 0))


def _with_places(rows: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the store names and identifiers of ``placed`` where it has their receipt."""
    at = placed.select(*keys, "receipt_id", F.col("store_name").alias("_name"), F.col("store_entity_id").alias("_entity"))
    joined = rows.join(at, [*keys, "receipt_id"], "left")
    entity = F.col("store_entity_id") if "store_entity_id" in rows.columns else F.lit(None).cast("string")
    return joined.withColumn("store_name", F.coalesce("_name", "store_name")).withColumn("store_entity_id", F.coalesce(F.col("_entity"), entity)).drop("_name", "_entity")


def add_receipts(
    receipts: DataFrame, rows: DataFrame, stores: DataFrame, store_aliases: DataFrame, as_of, currency: str = "kr", keys: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """``receipts, stores, changes, rejects`` after typed rows (see :func:`maintain.load_receipts`) are added."""
    keys = list(keys)
    good, rejects = maintain.load_receipts(rows, as_of, currency)
    if keys:
        good = good.join(rows.select(*keys, "receipt_id"), "receipt_id")
    none = F.array().cast(good.schema["line_items_raw"].dataType)
    good = settle(good.withColumn("line_items_raw", F.coalesce("line_items_raw", none)))
    placed, stores = place_stores(good, stores, store_aliases, as_of, keys)
    added = settle(_with_places(good, placed, keys))
    feed = change_feed(added.where("false"), added, keys)
    return {"receipts": receipts.unionByName(added, allowMissingColumns=True), "stores": stores, "changes": feed, "rejects": rejects}


def update_receipts(
    receipts: DataFrame, updates: DataFrame, stores: DataFrame, store_aliases: DataFrame, as_of, keys: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """``receipts, stores, changes, store_aliases`` after user updates (see :func:`maintain.apply_receipt_updates`).

    A corrected store name is looked up as alias and store, with the stored hints of its receipt; a name that was
    replaced becomes an alias of the new one. Updates with an unreadable date or category do nothing, and start no store.
    """
    keys = list(keys)
    on = [*keys, "receipt_id"]
    given = lambda name: F.coalesce(F.array_contains("fields", name), F.lit(False))
    bad_date = given("purchased_at") & blank_to_null(F.col("purchased_at")).isNotNull() & F.trim("purchased_at").try_cast("timestamp").isNull()
    bad_category = given("receipt_category") & blank_to_null(F.col("receipt_category")).isNotNull() & category_alias(F.col("receipt_category")).isNull()
    name = normalize_store_name(F.col("store_name"))
    # A name is normalised once; all that follows reads the result.
    updates = pin(updates.withColumn("store_name", name).withColumn("_valid", ~F.coalesce(bad_date | bad_category, F.lit(False))))
    named = updates.where(given("store_name") & F.col("_valid")).select(*on, "store_name")
    known = receipts.select(*on, *([F.col(f"merchant_hints.{c}").alias(c) for c in ("branch_name", *HINT_FIELDS)] if "merchant_hints" in receipts.columns else []))
    placed, stores = place_stores(named.join(known, on), stores, store_aliases, as_of, keys)
    ready = _with_places(updates.drop("_valid"), placed, keys)
    before = receipts if "store_entity_id" in receipts.columns else receipts.withColumn("store_entity_id", F.lit(None).cast("string"))
    after, fixes = maintain.apply_receipt_updates(before, ready, keys)
    after = settle(after)
    fixes = fixes.withColumn("corrected_at", instant(as_of))
    return {
        "receipts": after, "stores": stores, "changes": change_feed(before, after, keys),
        "store_aliases": learn_store_aliases(store_aliases, fixes, keys),
    }


def reread_receipts(
    receipts: DataFrame, stores: DataFrame, store_aliases: DataFrame, as_of, since: str | None = None, until: str | None = None,
    limit: int | None = None, overwrite: bool = False, keys: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """``receipts`` (the changed ones), ``stores, changes`` after receipts are read again from their stored text.

    See :func:`maintain.reparse_receipts` for the range and the columns. A store name that was read is looked up
    as alias and store; the category follows from the new name and text, the subcategories from the category.
    """
    keys = list(keys)
    on = [*keys, "receipt_id"]
    if "store_entity_id" not in receipts.columns:
        receipts = receipts.withColumn("store_entity_id", F.lit(None).cast("string"))
    read = settle(maintain.reread(receipts, as_of, since, until, limit, overwrite))
    old_name = receipts.select(*on, F.col("store_name").alias("_before"))
    named = read.join(old_name, on).where(~F.col("store_name").eqNullSafe(F.col("_before"))).select(*on, "store_name")
    placed, stores = place_stores(named, stores, store_aliases, as_of, keys)
    rows = _with_places(read, placed, keys)
    none = F.lit(None).cast("string")
    inferred = infer_category(F.col("store_name"), F.col("filename"), F.col("raw_text"), F.col("ocr_text"), F.col("receipt_category_model"))
    category, source = auto_category(F.lit(False), none, none, F.col("receipt_category"), F.col("receipt_category_source"), inferred)
    rows = pin(rows.withColumn("_category", category).withColumn("_source", source))
    moved = ~F.col("_category").eqNullSafe(F.col("receipt_category")) | ~F.col("_source").eqNullSafe(F.col("receipt_category_source"))
    split = auto_subcategories(
        F.lit(None).cast(SUBCATEGORY_ROWS), F.col("receipt_subcategories_model"), F.col("receipt_subcategories"), F.col("_category"), moved, F.col("total"))
    rows = rows.withColumn("receipt_subcategories", split).withColumn("receipt_category", F.col("_category")).withColumn("receipt_category_source", F.col("_source"))
    rows = settle(rows.select(*[c for c in receipts.columns if c in rows.columns]))
    feed = change_feed(receipts.join(rows.select(*on), on, "left_semi"), rows, keys)
    return {"receipts": rows.join(feed.select(*on), on, "left_semi"), "stores": stores, "changes": feed}


def apply_changes(receipts: DataFrame, changed: DataFrame, feed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``receipts`` after a feed: rows of ``changed`` replace or add to those of the same id, deleted ones go."""
    on = [*keys, "receipt_id"]
    kept = receipts.join(feed.select(*on), on, "left_anti")
    fresh = changed.join(feed.where("kind <> 'delete'").select(*on), on, "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True)
